import numpy as np

from elastrain.plans import local_steps
from elastrain.plans.learners import LinearSoftmax, ReluNet, local_step
from elastrain.schema import SolverParams


def test_a_large_batch_is_folded_in_pieces(monkeypatch):
    draw = np.random.default_rng(1)
    solver = SolverParams(base_lr=0.5, max_iter=2, momentum=0.9, weight_decay=0.004, batch_size=1000)
    for learner in (LinearSoftmax(8, 3), ReluNet(8, 5, 3)):
        start = [draw.normal(size=spec.size) for spec in learner.layers()]
        x, y = draw.normal(size=(2, 1000, 8)), draw.integers(0, 3, (2, 1000)).astype(float)
        monkeypatch.setattr(local_steps, "PIECE", 800)
        worker, held = local_steps._Worker(0, learner, solver, local_steps.RoundRule()), 0
        for spec, values in zip(learner.layers(), start):
            worker.add_block(spec.layer, 0, values.copy(), np.zeros(spec.size))
        for step in range(2):
            for lo in range(0, 1000, 30):
                worker.add_samples(step, x[step, lo : lo + 30], y[step, lo : lo + 30])
                held = max(held, sum(len(part) for part, _ in worker.parts))
        list(worker.rows())
        params, velocity = [p.copy() for p in start], [np.zeros_like(p) for p in start]
        losses = [local_step(learner, params, velocity, x[t], y[t], t, solver)[0] for t in range(2)]
        assert held <= 100 and np.allclose([loss for _, loss, _ in worker.log], losses, rtol=1e-12)
        assert all(np.allclose(a, b, rtol=1e-10, atol=1e-12) for a, b in zip(worker.params, params))
