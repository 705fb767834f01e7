"""Skill models: generalized Bradley-Terry and a graded item-response model."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.derive import MAX_FORECASTERS
from ..plans.lineage import cut


def _wins(theta: list[float]):
    """Rows (u, p) of problems to each forecaster's expected wins w and weight d, a row for each in a task."""
    import numpy as np
    import pyarrow as pa

    skill = np.array(theta)

    def run(batches):
        w, d = np.zeros(len(skill)), np.zeros(len(skill))
        for batch in batches:
            u, p = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
            s = skill[u] * p
            total = np.bincount(at, s, batch.num_rows)[at]
            w += np.bincount(u, np.divide(s, total, out=np.zeros_like(s), where=total != 0), len(skill))
            d += np.bincount(u, 1 / np.bincount(at, skill[u], batch.num_rows)[at], len(skill))
        seen = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(w[seen]), pa.array(d[seen])], ["u", "w", "d"])

    return run


def bradley_terry(problems: DataFrame, forecasts: DataFrame, iterations: int = 100, threshold: float = 1e-3, trajectory: bool = False) -> DataFrame:
    """(username, score, rank): skills by minorization-maximization; with `trajectory`, (iteration, username, score).

    The forecasts are laid out by problem once, a row for each, and stay cached; each
    step takes the skills (a value for each forecaster) along and sums, with no shuffle
    but that of partial sums. Problems without a correct option are left out.
    """
    x = forecasts.join(problems.where("size(correct_option_idx) > 0").select("problem_id", "correct_option_idx"), "problem_id").where("username is not null")
    x = x.groupBy("problem_id", "username").agg(F.max_by(F.get("probs", F.get("correct_option_idx", F.lit(0))), "forecast_seq").alias("p"))
    x = cut(x)
    spark = forecasts.sparkSession
    names = sorted(r[0] for r in x.select("username").distinct().collect())  # a row for each forecaster
    numbers = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)))), "username string, u int"))
    x = x.join(numbers, "username").groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("u", F.coalesce("p", F.lit(0.0)).alias("p")))).alias("f"))
    x = x.select(F.col("f.u").alias("u"), F.col("f.p").alias("p")).persist()
    theta = dict.fromkeys(names, 1.0)
    steps = [(0, u, 1.0) for u in names]
    for k in range(iterations):
        sums = x.mapInArrow(_wins([theta[u] for u in names]), "u int, w double, d double").groupBy("u").agg(F.sum("w").alias("w"), F.sum("d").alias("d")).collect()
        new = {names[r["u"]]: r["w"] / r["d"] for r in sums}
        scale = len(new) / (sum(new.values()) or 1.0)
        new = {u: v * scale for u, v in new.items()}
        far = max((abs(new[u] - theta[u]) for u in new), default=0.0)
        theta = new
        steps += [(k + 1, u, v) for u, v in theta.items()]
        if far < threshold:
            break
    x.unpersist()
    if trajectory:
        return spark.createDataFrame(steps, "iteration int, username string, score double")
    out = spark.createDataFrame(list(theta.items()), "username string, score double")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "username")))


def _levels(scores: DataFrame, anchors: int, strategy: str) -> list[float]:
    if anchors < 2:
        raise ValueError("at least two anchors are needed")
    steps = [k / (anchors - 1) for k in range(anchors)]
    if strategy == "uniform":
        return steps
    found = scores.agg(F.percentile("score", F.array(*map(F.lit, steps))).alias("q")).first()["q"]
    return sorted(set(found or [])) or steps


def _names(r: int) -> list[str]:
    """The sums of a problem: gradient (g) and expected curvature (f) of location b,
    log-discrimination a and the r shifts p."""
    return ["gb", "ga", "fbb", "fab", "faa", *(f"{x}{j}" for x in ("gp", "fbp", "fap") for j in range(r)), *(f"fpp{i}_{j}" for i in range(r) for j in range(i, r))]


def _slopes(rows: DataFrame, levels: list[float], shift: list[float], key: str) -> DataFrame:
    """Rows (key, k, n, t, a, b) to derivatives of their log-likelihood, by Arrow batches:
    g and h of the location for forecasters, the sums of `_names` for problems."""
    import numpy as np
    import pyarrow as pa

    c, p = 1 - np.array(levels), np.array(shift)
    r = len(levels)
    names = [key, *(["g", "h"] if key == "username" else _names(r))]

    def run(batches):
        for batch in batches:
            k, n, t, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            at, d = np.arange(len(k)), np.exp(a)
            z = d[:, None] * c * (t[:, None] - b[:, None] - p)
            q = np.exp(z - z.max(1, keepdims=True)) if len(k) else z
            q /= q.sum(1, keepdims=True)
            mean, mean_z = q @ c, (q * z).sum(1)
            from_mean = c - mean[:, None]
            g, h = n * d * (c[k] - mean), n * d * d * (q * from_mean**2).sum(1)
            if key == "username":
                out = [g, h]
            else:
                from_z, seen, w = z - mean_z[:, None], np.zeros_like(q), n * d * d
                seen[at, k] = 1
                out = [-g, n * (z[at, k] - mean_z), h, -n * d * (q * from_mean * from_z).sum(1), n * (q * from_z**2).sum(1)]
                out += [n * d * c[j] * (q[:, j] - seen[:, j]) for j in range(r)]
                out += [w * c[j] * q[:, j] * from_mean[:, j] for j in range(r)]
                out += [-n * d * c[j] * q[:, j] * from_z[:, j] for j in range(r)]
                out += [w * c[i] * c[j] * q[:, i] * ((i == j) - q[:, j]) for i in range(r) for j in range(i, r)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names)

    return rows.select(key, "k", "n", "t", "a", "b").mapInArrow(run, ", ".join([f"{key} string", *(f"{x} double" for x in names[1:])])).groupBy(key).agg(*(F.sum(x).alias(x) for x in names[1:]))


def _parts(batch, r: int):
    """Of problems with their sums: gradient (2), inverse curvature (2 x 2) and cross terms (2 x r) of (b, a), priors included."""
    import numpy as np

    v = {x: batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("a", "b", *_names(r))}
    g = np.stack([v["gb"] - v["b"] / 25, v["ga"] - v["a"]], 1)
    bb, aa, ab = v["fbb"] + 1 / 25, v["faa"] + 1, v["fab"]
    inverse = np.stack([aa, -ab, -ab, bb], 1).reshape(-1, 2, 2) / (bb * aa - ab * ab)[:, None, None]
    cross = np.stack([np.stack([v[f"{x}{j}"] for j in range(r)], 1) for x in ("fbp", "fap")], 1)
    return v, g, inverse, cross


def _shift_step(items: DataFrame, shift: list[float]):
    """The joint step of the shifts: problems are eliminated (Schur's complement), of which only sums move."""
    import numpy as np
    import pyarrow as pa

    r = len(shift)
    names = [f"x{j}" for j in range(r + r * r)]

    def run(batches):
        total = np.zeros((r, r + 1))
        for batch in batches:
            v, g, inverse, cross = _parts(batch, r)
            m = batch.column(batch.schema.get_field_index("m")).to_numpy(zero_copy_only=False)
            half = np.einsum("ixj,ixy,i->ijy", cross, inverse, m)
            total[:, 0] += [v[f"gp{j}"] @ m for j in range(r)] - np.einsum("ijy,iy->j", half, g)
            total[:, 1:] += [[v[f"fpp{min(i, j)}_{max(i, j)}"] @ m for j in range(r)] for i in range(r)] - np.einsum("ijy,iyk->jk", half, cross)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], names)

    sums = items.mapInArrow(run, ", ".join(f"{x} double" for x in names)).agg(*(F.sum(x).alias(x) for x in names)).first()  # one row
    total = np.array([x or 0.0 for x in sums]).reshape(r, r + 1)
    step = np.linalg.solve(total[:, 1:] + np.eye(r) / 25, total[:, 0] - np.array(shift) / 25)
    return step / max(1.0, np.abs(step).max())


def _moved(items: DataFrame, step, share: float) -> DataFrame:
    """(problem_id, m, a, b, sd, a0, b0): the problems after their step, given that of the shifts; a0 and b0 before."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            v, g, inverse, cross = _parts(batch, len(step))
            d = np.einsum("ixy,iy->ix", inverse, g - cross @ step)
            d *= (share / np.maximum(1, np.abs(d).max(1, initial=0)))[:, None]
            out = [v["a"] + d[:, 1], v["b"] + d[:, 0], 1 / np.sqrt(v["fbb"] + 1 / 25), v["a"], v["b"]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("problem_id", "m")), *map(pa.array, out)], ["problem_id", "m", "a", "b", "sd", "a0", "b0"])

    return items.mapInArrow(run, "problem_id string, m double, a double, b double, sd double, a0 double, b0 double")


def _flat(people, problems, shift: list[float], free: list[bool]):
    """(d, e, s): abilities t to (t + d) s, locations b to (b + d - e) s, free shifts p to (p + e) s, log a
    less log s leave the likelihood as it is; these are the ones that the priors like best."""
    n_t, t1, t2 = people
    n_b, b1, b2, a1 = problems
    p = [v for v, f in zip(shift, free) if f]
    # (n_t + n_b / 25) d - n_b e / 25 = -t1 - b1 / 25 and -n_b d + (n_b + len(p)) e = b1 - sum(p)
    m = (n_t + n_b / 25) * (n_b + len(p)) - n_b * n_b / 25
    x, y = -t1 - b1 / 25, b1 - sum(p)
    d, e = (x * (n_b + len(p)) + n_b / 25 * y) / m, ((n_t + n_b / 25) * y + n_b * x) / m
    size = t2 + 2 * d * t1 + n_t * d * d + (b2 + 2 * (d - e) * b1 + n_b * (d - e) ** 2) / 25
    size += sum((v + e) ** 2 if f else v * v for v, f in zip(shift, free)) / 25
    s = 0.0
    for _ in range(60):
        grown = size * math.exp(2 * s)
        s -= max(-1.0, min(1.0, (grown - a1 + n_b * s) / (2 * grown + n_b)))
    return d, e, math.exp(s)


def _kinds(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems of equal cells have equal parameters at the mode, so each kind is fitted once and counted by its problems: (the cells of the least problem
    of each kind, with the number m of its problems; (problem_id, like), like being that least one). Kinds are told by their
    number of cells and 128 bits of hashes, which move as one row a problem."""
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "username", "k", "n"))
    every = cut(cells.groupBy("problem_id").agg(F.count("*").alias("c"), mark(1).alias("h1"), mark(2).alias("h2")))
    kinds = cut(every.groupBy("c", "h1", "h2").agg(F.min("problem_id").alias("like"), F.count("*").cast("double").alias("m")))
    near = F.broadcast if kinds.count() <= MAX_FORECASTERS else lambda x: x
    return cut(cells.join(near(kinds.select(F.col("like").alias("problem_id"), "m")), "problem_id")), every.join(near(kinds), ["c", "h1", "h2"]).select("problem_id", "like")


def item_response(scores: DataFrame, anchors: int = 6, strategy: str = "uniform", rounds: int = 100, tolerance: float = 0.02) -> DataFrame:
    """(kind, id, location, discrimination, sd) from (username, problem_id, score in [0, 1], low is good).

    kind is forecaster (location: ability) or problem (location: difficulty).
    Scores go to the nearest of the anchors (even levels, or quantiles). Level k
    has logit a (1 - level) (ability - difficulty - shift[k]); priors are normal,
    with deviation 1 for abilities and log a, 5 for the rest. The posterior mode
    comes from rounds of scoring steps: all forecasters, then all problems and shifts
    jointly, then the moves that only the priors see. They end when no ability,
    difficulty, log a or shift moves by `tolerance` in a round; a fit that does not get
    there in `rounds` is an error. sd is the curvature's (Laplace). Steps are joins,
    grouped sums and passes over problems, so no task holds the rows of a forecaster
    or a problem, and the state is two tables written between the steps. Problems with equal cells are fitted
    as one, counted by their number, which is exact. Null scores are dropped.
    """
    known = scores.where("score is not null and username is not null and problem_id is not null")
    levels = _levels(known, anchors, strategy)
    marks = F.array(*(F.lit(v) for v in levels))
    k = F.array_min(F.transform(marks, lambda v, i: F.struct(F.abs(F.col("score") - v).alias("far"), i.alias("k"))))["k"]
    x = known.select(F.col("username").cast("string").alias("username"), F.col("problem_id").cast("string").alias("problem_id"), k.alias("k"))
    x = cut(x.groupBy("username", "problem_id", "k").agg(F.count("*").cast("double").alias("n")))
    users = cut(x.select("username").distinct().select("username", F.lit(0.0).alias("t"), F.lit(1.0).alias("sd")))
    x, like = _kinds(x)
    items = cut(x.select("problem_id", "m").distinct().select("problem_id", "m", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(5.0).alias("sd")))
    shift, free = [0.0] * len(levels), [v != 1 for v in levels]
    far = 0.0 if x.isEmpty() else math.inf
    for turn in range(rounds):
        if far < tolerance:
            break
        share = 1.0 if turn < 30 else 0.5
        rows = lambda: x.join(items.select("problem_id", "a", "b"), "problem_id").join(users.select("username", "t"), "username")
        sums = _slopes(rows().withColumn("n", F.col("n") * F.col("m")), levels, shift, "username")
        move = F.greatest(F.lit(-share), F.least(F.lit(share), share * (F.col("g") - F.col("t")) / (F.col("h") + 1)))
        users = cut(users.select("username", "t").join(sums, "username").select("username", (F.col("t") + move).alias("t"), (1 / F.sqrt(F.col("h") + 1)).alias("sd"), F.col("t").alias("t0")))
        full = cut(items.select("problem_id", "m", "a", "b").join(_slopes(rows(), levels, shift, "problem_id"), "problem_id"))
        step = _shift_step(full, shift)
        items = cut(_moved(full, step, share))
        before, shift = shift, [v + share * float(w) for v, w in zip(shift, step)]
        people = users.agg(F.count("*"), F.sum("t"), F.sum(F.col("t") ** 2)).first()
        problems = items.agg(F.sum("m"), F.sum(F.col("b") * F.col("m")), F.sum(F.col("b") ** 2 * F.col("m")), F.sum(F.col("a") * F.col("m"))).first()
        d, e, s = _flat(people, problems, shift, free)
        shift = [(v + e) * s if f else v * s for v, f in zip(shift, free)]
        users = users.withColumn("t", (F.col("t") + d) * s)
        items = items.withColumns({"b": (F.col("b") + (d - e)) * s, "a": F.col("a") - math.log(s)})
        far = max(abs(v - w) for v, w in zip(shift, before))
        far = max(far, users.agg(F.max(F.abs(F.col("t") - F.col("t0")))).first()[0], items.agg(F.max(F.greatest(F.abs(F.col("b") - F.col("b0")), F.abs(F.col("a") - F.col("a0"))))).first()[0])
    if not far < tolerance:
        raise RuntimeError(f"the fit still moves by {far:.3g} after {rounds} rounds (tolerance {tolerance})")
    people = users.select(F.lit("forecaster").alias("kind"), F.col("username").alias("id"), F.col("t").alias("location"), F.lit(None).cast("double").alias("discrimination"), "sd")
    items = like.join(items.withColumnRenamed("problem_id", "like"), "like")
    return people.unionByName(items.select(F.lit("problem").alias("kind"), F.col("problem_id").alias("id"), F.col("b").alias("location"), F.exp("a").alias("discrimination"), "sd"))


def posterior_summary(table: DataFrame) -> DataFrame:
    """The fitted table with the 5, 25, 50, 75 and 95 % points of each location."""
    z = {f"p{q}": NormalDist().inv_cdf(q / 100) for q in (5, 25, 50, 75, 95)}
    return table.withColumns({k: F.col("location") + v * F.col("sd") for k, v in z.items()})
