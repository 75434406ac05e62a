"""Losses, accumulated gradients, scores and single solver steps."""

from pyspark.sql import functions as F

from elastrain.catalog.common import BATCH, SEED, SQL_LOG, SQL_SHUFFLED, samples, shuffled
from elastrain.catalog.registry import query
from elastrain.catalog.schedules import PERIOD, numbered_log
from elastrain.functions.scores import cross_entropy, hit_at, softmax
from elastrain.operators import aggregates as A
from elastrain.operators.batching import number_batches
from elastrain.operators.weights import chunked
from elastrain.plans.learners import LinearSoftmax, ReluNet
from elastrain.plans.parameters import init_weights, layer_table
from elastrain.plans.scoring import evaluate, score, sgd_step

LINEAR = LinearSoftmax(64, 10)
RATE = 5.0


def loss_log(spark, sf_dir):
    """Numbered losses; the clock's milliseconds stand for the time of a step."""
    return numbered_log(spark, sf_dir).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")) % 1000)


@query("period_loss", f"""
WITH {SQL_LOG} SELECT worker, (iter - 1) // {PERIOD} AS span, max(iter) AS iter, round(avg(loss), 6) AS loss,
  (sum((epoch_us(ts) // 1000) % 1000) // count(*))::bigint AS mean_ms, count(*) AS steps
FROM log GROUP BY worker, (iter - 1) // {PERIOD}""")
def period_loss(spark, sf_dir):
    return A.period_loss(loss_log(spark, sf_dir), PERIOD).withColumn("loss", F.round("loss", 6))


@query("accumulate_gradients", f"""
WITH {SQL_SHUFFLED}, long AS (
  SELECT worker, (pos - 1) // {BATCH} AS push, unnest(range(64))::bigint AS j, unnest(data)::double AS x FROM shuffled)
SELECT worker, push, j, round(sum(x), 6) + 0.0 AS value FROM long GROUP BY worker, push, j""")
def accumulate_gradients(spark, sf_dir):
    """Each vector is the update of one step of its worker; ten steps make a push."""
    steps = shuffled(spark, sf_dir).select("worker", (F.col("pos") - 1).alias("step"), F.lit(0).alias("layer"), "data")
    blocks = chunked(steps, "data", keep=("worker", "step"))
    pushed = A.accumulate_gradients(blocks, BATCH, ["worker", "layer", "chunk"])
    return pushed.select("worker", "push", F.posexplode("values").alias("j", "value")).select(
        "worker", "push", F.col("j").cast("bigint").alias("j"), (F.round("value", 6) + 0.0).alias("value"))


SQL_SCORES = """scores AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::double) AS s FROM embeddings),
scored AS (
  SELECT id, label, (len(list_filter(s, lambda x: x > s[label + 1])) < 1)::int::double AS hit1,
         (len(list_filter(s, lambda x: x > s[label + 1])) < 5)::int::double AS hit5,
         ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[label + 1] AS loss FROM scores)"""


def scored_rows(spark, sf_dir):
    """The values of each vector as the scores of 64 classes."""
    rows = samples(spark, sf_dir).select("id", "label", F.col("data").cast("array<double>").alias("scores"))
    return rows.select(
        "id", "label", "scores", hit_at(F.col("scores"), F.col("label"), 1).alias("hit1"),
        hit_at(F.col("scores"), F.col("label"), 5).alias("hit5"), cross_entropy(F.col("scores"), F.col("label")).alias("loss"))


@query("row_scores", f"WITH {SQL_SCORES} SELECT id, hit1, hit5, round(loss, 6) AS loss FROM scored")
def row_scores(spark, sf_dir):
    return scored_rows(spark, sf_dir).select("id", "hit1", "hit5", F.round("loss", 6).alias("loss"))


@query("accuracy_and_loss", f"""
WITH {SQL_SCORES} SELECT round(avg(hit1), 6) AS accuracy_1, round(avg(hit5), 6) AS accuracy_5,
  round(avg(loss) * 0.3, 6) AS loss, count(*) AS n FROM scored""")
def accuracy_and_loss(spark, sf_dir):
    found = A.accuracy_and_loss(scored_rows(spark, sf_dir), "scores", "label", (1, 5), loss_weight=0.3)
    return found.select(*[F.round(c, 6).alias(c) for c in ("accuracy_1", "accuracy_5", "loss")], "n")


@query("mean_scores", f"""
WITH {SQL_SCORES}, batched AS (
  SELECT *, (row_number() OVER (ORDER BY md5('{SEED}:' || id)) - 1) // 64 AS batch, count(*) OVER () // 64 AS batches FROM scored),
used AS (SELECT * FROM batched WHERE batch < batches)
SELECT o.output, round(CASE o.output WHEN 'accuracy_1' THEN avg(hit1) WHEN 'accuracy_5' THEN avg(hit5) ELSE avg(loss) * 0.3 END, 6) AS mean_score,
  max(batches) AS batches, (SELECT count(*) FROM batched WHERE batch >= batches) AS left_over
FROM used, (VALUES ('accuracy_1'), ('accuracy_5'), ('loss')) AS o(output) GROUP BY o.output""")
def mean_scores(spark, sf_dir):
    rows = scored_rows(spark, sf_dir).withColumnsRenamed({"hit1": "accuracy_1", "hit5": "accuracy_5"})
    numbered = number_batches(rows, ["id"], SEED, 64)
    found = A.mean_scores(numbered, {"accuracy_1": 0.0, "accuracy_5": 0.0, "loss": 0.3})
    return found.withColumn("mean_score", F.round("mean_score", 6))


TEST_ITER = 100


@query("mean_scores_test_iter", f"""
WITH {SQL_SCORES}, batched AS (
  SELECT *, (row_number() OVER (ORDER BY md5('{SEED}:' || id)) - 1) // 64 AS batch, count(*) OVER () // 64 AS batches FROM scored),
taken AS (SELECT i % batches AS batch FROM range({TEST_ITER}) AS r(i), (SELECT max(batches) AS batches FROM batched)),
used AS (SELECT * FROM taken JOIN batched USING (batch))
SELECT o.output, round(CASE o.output WHEN 'accuracy_1' THEN avg(hit1) WHEN 'accuracy_5' THEN avg(hit5) ELSE avg(loss) * 0.3 END, 6) AS mean_score,
  max(batches) AS batches, (SELECT count(*) FROM batched WHERE batch NOT IN (SELECT batch FROM taken)) AS left_over
FROM used, (VALUES ('accuracy_1'), ('accuracy_5'), ('loss')) AS o(output) GROUP BY o.output""")
def mean_scores_test_iter(spark, sf_dir):
    """A hundred batches, going round the test set as often as that takes."""
    rows = scored_rows(spark, sf_dir).withColumnsRenamed({"hit1": "accuracy_1", "hit5": "accuracy_5"})
    found = A.mean_scores(number_batches(rows, ["id"], SEED, 64), {"accuracy_1": 0.0, "accuracy_5": 0.0, "loss": 0.3}, TEST_ITER)
    return found.withColumn("mean_score", F.round("mean_score", 6))


@query("heads_report", """
WITH rows AS (SELECT label, list_transform(embedding, lambda x: x::double) AS s FROM embeddings),
heads AS (
  SELECT 'main' AS head, 1.0::double AS weight, label, s FROM rows
  UNION ALL SELECT 'first', 0.3::double, label, list_transform(s, lambda x: x * 0.5::double) FROM rows
  UNION ALL SELECT 'second', 0.3::double, label, list_reverse(s) FROM rows),
scored AS (
  SELECT head, (len(list_filter(s, lambda x: x > s[label + 1])) < 1)::int::double AS hit1,
         (len(list_filter(s, lambda x: x > s[label + 1])) < 5)::int::double AS hit5,
         weight * (ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[label + 1]) AS loss FROM heads),
by_head AS (SELECT head, avg(hit1) AS a1, avg(hit5) AS a5, avg(loss) AS loss, count(*) AS n FROM scored GROUP BY head)
SELECT head, round(a1, 6) AS accuracy_1, round(a5, 6) AS accuracy_5, round(loss, 6) AS loss,
  round(sum(loss) OVER (), 6) AS total_loss, n FROM by_head""")
def heads_report(spark, sf_dir):
    """The vector, half of it and its reverse as the class scores of a last and two auxiliary heads."""
    rows = samples(spark, sf_dir).select("label", F.col("data").cast("array<double>").alias("main"))
    rows = rows.select("*", F.transform("main", lambda x: x * 0.5).alias("first"), F.reverse("main").alias("second"))
    found = A.heads_report(rows, {"first": 0.3, "second": 0.3, "main": 1.0}, "label")
    return found.select("head", *[F.round(c, 6).alias(c) for c in ("accuracy_1", "accuracy_5", "loss", "total_loss")], "n")


def start_state(spark):
    return init_weights(layer_table(spark, LINEAR.layers()), seed=1).withColumn("velocity", F.transform("values", lambda x: x * 0))


def after_steps(spark, sf_dir, steps):
    """Full-batch softmax steps from zero weights, with momentum and weight decay."""
    state = start_state(spark)
    for _ in range(steps):
        state = sgd_step(samples(spark, sf_dir), state, LINEAR, RATE, momentum=0.9, weight_decay=0.004)
    return state


def _sql_steps(steps):
    """Weights of a dense softmax layer after full-batch steps, as CTEs w0, w1, ... (cls, j, w, v); j = -1 is the bias."""
    ctes = ["""x AS (SELECT vec_id AS id, label, unnest(range(-1, 64))::int AS j, unnest(list_prepend(1.0::double, embedding::double[])) AS x FROM embeddings)""",
            "w0 AS (SELECT c::int AS cls, j::int AS j, 0.0::double AS w, 0.0::double AS v FROM range(10) AS a(c), range(-1, 64) AS b(j))"]
    for k in range(steps + 1):
        ctes.append(f"""s{k} AS (SELECT id, label, cls, sum(x * w) AS s FROM x JOIN w{k} USING (j) GROUP BY id, label, cls)""")
        ctes.append(f"""p{k} AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s)) OVER (PARTITION BY id) * exp(max(s) OVER (PARTITION BY id)) AS p FROM s{k})""")
        if k < steps:
            ctes.append(f"""g{k} AS (SELECT cls, j, sum((p - (cls = p{k}.label)::int) * x) / (SELECT count(*) FROM embeddings) AS g
  FROM p{k} JOIN x USING (id) GROUP BY cls, j)""")
            ctes.append(f"""u{k} AS (SELECT cls, j, w, 0.9::double * v + {RATE}::double * (CASE WHEN j < 0 THEN 2 ELSE 1 END) * (g + CASE WHEN j < 0 THEN 0 ELSE 0.004::double END * w) AS v
  FROM w{k} JOIN g{k} USING (cls, j))""")
            ctes.append(f"w{k + 1} AS (SELECT cls, j, w - v AS w, v FROM u{k})")
    return ", ".join(ctes)


def _sql_report(k):
    return f"""SELECT {k}::int AS step, round(avg(-ln(p)) FILTER (cls = label), 6) AS loss,
  round(avg((higher < 1)::int::double) FILTER (cls = label), 6) AS accuracy_1, round(avg((higher < 5)::int::double) FILTER (cls = label), 6) AS accuracy_5,
  count(*) FILTER (cls = label) AS n
FROM (SELECT a.*, (SELECT count(*) FROM p{k} b WHERE b.id = a.id AND b.s > a.s) AS higher FROM p{k} a)"""


@query("sgd_steps", f"""
WITH {_sql_steps(2)} SELECT cls, j, round(w, 6) + 0.0 AS w, round(v, 6) + 0.0 AS v FROM w2""")
def sgd_steps(spark, sf_dir):
    """Every weight and velocity after two full-batch steps; j = -1 is the bias."""
    state = after_steps(spark, sf_dir, 2)
    cells = state.select("layer", F.posexplode(F.arrays_zip("values", "velocity")).alias("i", "p"))
    bias = F.col("layer") == 1
    return cells.select(
        F.when(bias, F.col("i")).otherwise(F.floor(F.col("i") / 64)).cast("int").alias("cls"),
        F.when(bias, F.lit(-1)).otherwise(F.pmod("i", F.lit(64))).cast("int").alias("j"),
        (F.round("p.values", 6) + 0.0).alias("w"), (F.round("p.velocity", 6) + 0.0).alias("v"))


@query("one_step_report", f"WITH {_sql_steps(1)} {_sql_report(0)} UNION ALL {_sql_report(1)}")
def one_step_report(spark, sf_dir):
    """Loss and accuracies over all samples before and after one full-batch step."""
    before, after = start_state(spark), after_steps(spark, sf_dir, 1)

    def report(step, state):
        found = evaluate(samples(spark, sf_dir), state, LINEAR, ks=(1, 5))
        rounded = [F.round(c, 6).alias(c) for c in ("loss", "accuracy_1", "accuracy_5")]
        return found.select(F.lit(step).alias("step"), *rounded, "n")

    return report(0, before).unionByName(report(1, after))


@query("dense_scores", f"WITH {_sql_steps(1)} SELECT id, cls, round(s, 6) + 0.0 AS score, round(p, 6) AS p FROM p1")
def dense_scores(spark, sf_dir):
    """Scores and softmax of every sample and class after one step."""
    scored = score(samples(spark, sf_dir), after_steps(spark, sf_dir, 1), LINEAR)
    pairs = scored.select("id", F.posexplode(F.arrays_zip(F.col("scores"), softmax(F.col("scores")).alias("p"))).alias("cls", "x"))
    return pairs.select("id", "cls", (F.round("x.scores", 6) + 0.0).alias("score"), F.round("x.p", 6).alias("p"))


@query("dense_scores_by_blocks", f"WITH {_sql_steps(1)} SELECT id, cls, round(s, 6) + 0.0 AS score FROM p1")
def dense_scores_by_blocks(spark, sf_dir):
    """The same scores with the model sent out in many small slabs."""
    state = start_state(spark)
    state = sgd_step(samples(spark, sf_dir), state, LINEAR, RATE, momentum=0.9, weight_decay=0.004, limit=2048)
    scored = score(samples(spark, sf_dir), state, LINEAR, limit=2048)
    return scored.select("id", F.posexplode("scores").alias("cls", "score")).withColumn("score", F.round("score", 6) + 0.0)


@query("relu_scores", """
WITH long AS (SELECT vec_id AS id, label, unnest(range(64))::int AS j, unnest(embedding)::double AS x FROM embeddings),
means AS (SELECT label AS h, j, avg(x) AS m FROM long GROUP BY label, j),
hidden AS (SELECT id, h, greatest(sum(x * m) - 0.01::double * h, 0) AS a FROM long JOIN means USING (j) GROUP BY id, h)
SELECT id, c::int AS cls, round(sum(a * ((c + h) % 3 - 1)) + 0.1::double * c, 6) + 0.0 AS score
FROM hidden, range(10) AS r(c) GROUP BY id, c""")
def relu_scores(spark, sf_dir):
    """A hidden unit per label, whose weights are the label's mean vector, and a fixed layer on top."""
    rows = samples(spark, sf_dir)
    means = rows.groupBy(F.col("label").cast("int").alias("h")).agg(A.vector_sum(F.col("data")).alias("s"), F.count(F.lit(1)).alias("n"))
    cells = means.select("h", F.posexplode("s").alias("j", "v"), "n").select(
        F.lit(0).alias("layer"), (F.col("h") * 64 + F.col("j")).alias("i"), (F.col("v") / F.col("n")).alias("v"))
    top = spark.range(100).select(
        F.lit(2).alias("layer"), F.col("id").cast("int").alias("i"), ((F.expr("id div 10") + F.col("id") % 10) % 3 - 1).cast("double").alias("v"))
    ten = spark.range(10).select(F.col("id").cast("int").alias("i"))
    first, second = (ten.select(F.lit(k).alias("layer"), "i", (F.col("i") * w).cast("double").alias("v")) for k, w in ((1, -0.01), (3, 0.1)))
    every = cells.union(top).union(first).union(second).groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    weights = chunked(every.select("layer", F.transform("c", lambda c: c["v"]).alias("values")))
    scored = score(rows, weights, ReluNet(64, 10, 10), limit=1024)
    return scored.select("id", F.posexplode("scores").alias("cls", "score")).withColumn("score", F.round("score", 6) + 0.0)
