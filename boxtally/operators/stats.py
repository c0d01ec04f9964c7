"""Patient bootstrap, verdicts, temperature fit, feature readout, out-of-fold probes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions.values import draw, draws
from boxtally.operators.curves import union_all
from boxtally.operators.grade_metrics import calibration_bins, calibration_summary
from boxtally.operators.sampling import dense_index
from boxtally.session import cut_lineage

GRADES = (2, 3, 4, 5)


POINT = -1


def _dealt_out(index: DataFrame) -> DataFrame:
    """The numbered patients over all tasks: the window that numbers them leaves each group in one, where all draws would be made."""
    spark = index.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return index.repartition(parts, "idx")


def bootstrap_weights(patients: DataFrame, samples: int, point: bool = False) -> DataFrame:
    """How often each patient is drawn in each resample: (b, patient_id, w).

    Every resample makes as many draws with replacement as there are patients. Draw j of resample
    b is a digest of (b, j); draws are counted before any patient rows are touched, so a patient's
    rows are weighted and never copied. With ``point`` the full set comes along as resample ``POINT``.
    """
    index = dense_index(patients.select("patient_id").distinct(), [F.asc("patient_id")])
    total = index.agg(F.count(F.lit(1)).alias("_n"))
    draws = _dealt_out(index.join(F.broadcast(total))).select(F.col("idx").alias("j"), "_n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
    hit = draws.select(F.col("b").cast("long").alias("b"), (draw(F.col("b"), F.col("j")) % F.col("_n")).alias("idx"))
    counts = hit.groupBy("b", "idx").agg(F.count(F.lit(1)).alias("w"))
    drawn = counts.join(index, "idx").select("b", "patient_id", "w")
    if not point:
        return drawn
    return drawn.unionByName(index.select(F.lit(POINT).cast("long").alias("b"), "patient_id", F.lit(1).cast("long").alias("w")))


def bootstrap_hits(patients: DataFrame, samples: int, keys: Sequence[str] = ()) -> DataFrame:
    """The resamples that draw each patient, one entry per draw: (keys, patient_id, idx, of, hits).

    The draws are those of :func:`bootstrap_weights`, made anew within every group of ``keys``. A patient is one row
    with about ``samples`` entries, however many patients there are. A patient's draws follow from its number ``idx``
    among the ``of`` patients of its group: where ``hits`` is not read, Spark leaves out the join that gathers them.
    """
    k = list(keys)
    index = dense_index(patients.select(*k, "patient_id").distinct(), [F.asc("patient_id")], k)
    total = index.groupBy(*k).agg(F.count(F.lit(1)).alias("of"))
    sized = index.join(F.broadcast(total), k, "left") if k else index.join(F.broadcast(total))
    drawn = sized.filter("of IS NOT NULL")  # a group whose key is null has no draws
    draws_ = _dealt_out(drawn).select(*k, F.col("idx").alias("j"), "of", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
    hit = draws_.select(*k, "b", (draw(F.col("b"), F.col("j")) % F.col("of")).alias("idx"))
    # Spark takes a list for one entry, so the patients look small enough to be broadcast and are not
    per = hit.groupBy(*k, "idx").agg(F.collect_list("b").alias("hits")).hint("merge")
    return sized.join(per, [*k, "idx"], "left").select(*k, "patient_id", "idx", "of", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"))


def _draws(batch: pa.RecordBatch, samples: int) -> Iterator[np.ndarray]:
    """Per row how often it counts in the full set (place 0) and in every resample."""
    hits = batch.column("hits")
    flat, at = hits.values.to_numpy(zero_copy_only=False), hits.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:]):
        w = np.bincount(flat[a:b] + 1, minlength=samples + 1).astype(np.float64)
        w[0] = 1.0
        yield w


def _per_resample(key: Sequence, names: Sequence[str], vectors: Sequence[np.ndarray], out: Sequence[str]) -> pa.RecordBatch:
    """One row per resample of the vectors of one key; the full set is resample ``POINT``."""
    n = len(vectors[0])
    return pa.RecordBatch.from_arrays([*[pa.array([v] * n) for v in key], pa.array(np.arange(n) + POINT), *map(pa.array, vectors)], [*names, "b", *out])


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{c} {kinds[c]}" for c in names)


def resampled_sums(sums: DataFrame, hits: DataFrame, samples: int, cells: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of every resample and of the full set: (keys, cells, b, and the other columns of ``sums`` as doubles).

    ``sums`` has a row per (keys, patient_id, cells), the cells of a patient being few. Each task adds its patients up
    for all resamples at once, so what is shuffled is a row per task, cell and resample and none per patient.
    """
    k, names = list(keys), [*keys, *cells]
    values = [c for c in sums.columns if c not in (*names, "patient_id")]
    own = sums.groupBy(*k, "patient_id").agg(F.collect_list(F.struct(*cells, *[F.col(v).cast("double").alias(v) for v in values])).alias("own"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row, w in zip(batch.select([*k, "own"]).to_pylist(), _draws(batch, samples)):
                for cell in row["own"]:
                    name = (*[row[c] for c in k], *[cell[c] for c in cells])
                    if name not in held:
                        held[name] = np.zeros((len(values), samples + 1))
                    held[name] += np.array([cell[v] or 0.0 for v in values])[:, None] * w
        for name, vectors in held.items():
            yield _per_resample(name, names, list(vectors), values)

    ddl = ", ".join([_ddl(sums, names), "b bigint", *[f"{v} double" for v in values]])
    parts = own.join(hits.hint("merge"), [*k, "patient_id"]).select(*k, "own", "hits").mapInArrow(add, ddl)
    return parts.groupBy(*names, "b").agg(*[F.sum(v).alias(v) for v in values])


def resampled_confusion(pairs: DataFrame, hits: DataFrame, samples: int, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of every resample: (keys, b, true, predicted, n), cells that occur only."""
    per = pairs.groupBy(*keys, "patient_id", "true", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return resampled_sums(per, hits, samples, ["true", "predicted"], keys).withColumn("n", F.col("n").cast("long")).filter("n > 0")


def resampled_calibration(pairs: DataFrame, hits: DataFrame, samples: int, keys: Sequence[str] = ()) -> DataFrame:
    """The calibration figures of every resample that holds a row: (keys, b, n, brier, nll, ece, ...)."""
    per = calibration_bins(pairs, [*keys, "patient_id"])
    return calibration_summary(resampled_sums(per, hits, samples, ["bin"], keys).filter("n > 0"), [*keys, "b"])


#: Bytes of counts that a task of the macro AUROC holds: its resamples times the patients.
WEIGHTS_A_TASK = 64 << 20
#: Scores that are counted at a time.
CHUNK = 4096


def resampled_macro_auroc(pairs: DataFrame, hits: DataFrame, samples: int, models: dict[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Macro one-vs-rest AUROC of every resample and model: (keys, b, model, auroc); null where no grade is defined.

    Scores are ordered once and written in chunks, without any draws. A task makes the draws of a block of resamples
    itself, from ``idx`` and ``of`` of ``hits``, and reads the chunks one after the other, in any order. So no draw is
    shuffled or written, a task holds a bounded number of counts, and there are as many tasks as blocks. Groups of
    ``keys`` are few: their sizes go by the driver, and the tasks of a group pass over the chunks of the others.
    """
    spark, k = pairs.sparkSession, list(keys)
    columns = list(dict.fromkeys(c for cols in models.values() for c in cols))
    who = hits.select(*k, "patient_id", "idx", "of").hint("merge")
    # 0 is another grade; a row whose grade is not known counts on neither side
    grade = F.array_position(F.array(*[F.lit(g).cast("long") for g in GRADES]), F.col("true").cast("long")).cast("byte").alias("grade")
    rows = cut_lineage(pairs.filter(F.col("true").isNotNull()).join(who, [*k, "patient_id"]).select(*k, F.col("idx").cast("int").alias("idx"), "of", grade, *columns))
    scores = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("p")) for i, c in enumerate(columns)])).alias("e")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = rows.select(*k, "idx", "grade", scores).select(*k, "e.*", "idx", "grade")
    placed = long.repartitionByRange(parts, *k, "col", "p", "idx").sortWithinPartitions(*k, "col", "p")
    packed = "col int, part int, seq bigint, first double, last double, starts binary, idx binary, grade binary"
    chunks = cut_lineage(placed.mapInArrow(_chunks(k), ", ".join([_ddl(rows, k)] * bool(k) + [packed])))

    blocks, least = [], 2 * spark.sparkContext.defaultParallelism
    for *group, of in rows.groupBy(*k).agg(F.max("of").alias("of")).collect() if k else filter(any, rows.agg(F.max("of")).collect()):
        step = max(1, min(-(-(samples + 1) // least), WEIGHTS_A_TASK // of))
        blocks += [(*group, of, low, min(low + step, samples)) for low in range(POINT, samples, step)]
    ddl = ", ".join([_ddl(rows, k)] * bool(k) + ["of bigint, low int, high int"])
    # one block a partition; each pair of a block with all the chunks is a task, and nothing is shuffled
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(blocks, max(1, len(blocks))), ddl).hint("shuffle_replicate_nl")
    read = chunks.coalesce(1)
    met = read.join(dealt, k) if k else read.crossJoin(dealt)
    named = {m: [(code, columns.index(c)) for code, c in enumerate(cols[: len(GRADES)], 1)] for m, cols in models.items()}
    out = ", ".join([_ddl(rows, k)] * bool(k) + ["b bigint, model string, auroc double"])
    return met.mapInArrow(_block_aurocs(k, named), out)


def _chunks(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs sorted scores: a row per chunk of one group and column, numbered in order of score."""
    names = [*keys, "col"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            null, p = np.asarray(batch.column("p").is_null()), batch.column("p").to_numpy(zero_copy_only=False)
            other = (p[1:] != p[:-1]) & ~(np.isnan(p[1:]) & np.isnan(p[:-1])) | (null[1:] != null[:-1])
            cut = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
            for c in names:
                code = batch.column(c).dictionary_encode().indices.to_numpy()
                cut |= code[1:] != code[:-1]
            starts = np.concatenate([[True], other | cut])
            edges = sorted({*range(0, batch.num_rows, CHUNK), *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows})
            for a, b in zip(edges, edges[1:]):
                begins = starts[a:b].copy()
                begins[0] = True
                data = [x.tobytes() for x in (begins, batch.column("idx").to_numpy()[a:b], batch.column("grade").to_numpy()[a:b])]
                ends = [batch.column("p").slice(a, 1), batch.column("p").slice(b - 1, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, 1) for c in names], pa.array([part], pa.int32()), pa.array([seq], pa.int64()), *ends, *[pa.array([d], pa.binary()) for d in data]],
                    [*names, "part", "seq", "first", "last", "starts", "idx", "grade"],
                )
                seq += 1

    return pack


def _weights(of: int, low: int, high: int) -> np.ndarray:
    """How often each patient counts in the resamples from ``low`` to ``high``, a row each."""
    w = np.ones((high - low, of), dtype=np.uint8)
    for i, b in enumerate(range(low, high)):
        if b != POINT:
            counts = np.bincount(draws(b, of) % of, minlength=of)
            if counts.max() > np.iinfo(w.dtype).max:
                w = w.astype(np.int64)
            w[i] = counts
    return w


def _pieces(chunk: dict, w: np.ndarray, grades: Sequence[int]) -> Iterator[tuple]:
    """A chunk as its first tie, what lies between, and its last tie: (score or None, sum of all, {grade: (sum, wins)}).

    Wins of a grade are counted over all scores of the piece, those of the grade itself included.
    """
    starts, idx, grade = (np.frombuffer(chunk[c], t) for c, t in (("starts", bool), ("idx", np.int32), ("grade", np.int8)))
    x = w[:, idx].astype(np.float64)
    upto = np.cumsum(x, axis=1)
    at = np.flatnonzero(starts)
    tie = np.cumsum(starts) - 1
    half = upto[:, np.append(at[1:], len(idx)) - 1]
    half[:, 1:] += half[:, :-1].copy()
    half /= 2.0
    name = lambda p: str(p if p is None else p + 0.0)  # zero has one name
    spans = [(0, at[1], name(chunk["first"])), (at[1], at[-1], None), (at[-1], len(idx), name(chunk["last"]))] if len(at) > 1 else [(0, len(idx), name(chunk["first"]))]
    for a, b, p in spans:
        if a == b:
            continue
        below = upto[:, a - 1] if a else np.zeros(len(w))
        own = {}
        for g in grades:
            mine = np.flatnonzero(grade[a:b] == g) + a
            xs = x[:, mine]
            total = xs.sum(axis=1)
            own[g] = total, np.einsum("ij,ij->i", xs, half[:, tie[mine]]) - total * below
        yield p, upto[:, b - 1] - below, own


def _auroc(pieces: Sequence[tuple], g: int) -> np.ndarray:
    """AUROC of grade ``g`` against the rest per resample, from pieces in order of score; NaN where it is not defined."""
    joined: list[tuple] = []
    for p, total, own in pieces:
        mine, wins = own[g]
        if p is not None and joined and joined[-1][0] == p:  # the tie goes on
            _, t, m, _ = joined.pop()
            total, mine = t + total, m + mine
        if p is not None:
            wins = mine * total / 2.0
        joined.append((p, total, mine, wins))
    below, pos, won = 0.0, 0.0, 0.0
    for _, total, mine, wins in joined:
        won, pos, below = won + wins + mine * below, pos + mine, below + total
    of = pos * (below - pos)
    # the wins of a grade over itself are half its pairs
    return np.divide(won - pos * pos / 2.0, of, out=np.full(len(of), np.nan), where=of > 0)


def _block_aurocs(keys: Sequence[str], models: dict[str, list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Macro AUROCs of one block of resamples; ``models`` has (grade, column) pairs, grades counted from 1."""
    asked: dict[int, list[int]] = {}
    for pairs in models.values():
        for g, c in pairs:
            asked.setdefault(c, []).append(g)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {c: [] for c in asked}
        block, w = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.slice(i, 1).to_pylist()[0]
                if w is None:
                    block, w = chunk, _weights(chunk["of"], chunk["low"], chunk["high"])
                held[chunk["col"]].append((chunk["part"], chunk["seq"], list(_pieces(chunk, w, sorted({*asked[chunk["col"]]})))))
        if w is None:
            return
        ordered = {c: [p for *_, pieces in sorted(found, key=lambda f: f[:2]) for p in pieces] for c, found in held.items()}
        for m, pairs in models.items():
            each = np.array([_auroc(ordered[c], g) for g, c in pairs])
            defined = (~np.isnan(each)).sum(axis=0)
            macro = np.nansum(each, axis=0) / np.maximum(defined, 1)
            n = len(macro)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([block[c]] * n) for c in keys], pa.array(np.arange(block["low"], block["high"])), pa.array([m] * n), pa.array(macro, mask=defined == 0)],
                [*keys, "b", "model", "auroc"],
            )

    return count


def subgroup_delta(rows: DataFrame, members: dict[str, Column], a: Sequence[str], b: Sequence[str], samples: int) -> DataFrame:
    """Per subgroup the macro AUROC of two models, their difference with its interval, and what it rests on.

    Patients are drawn among those of the subgroup. ``status`` says when a subgroup holds no row or no difference is
    defined on the full set or in any resample; the figures that are not defined are null.
    """
    tagged = cut_lineage(subgroups(rows, members).select("subgroup", "patient_id", "true", *dict.fromkeys([*a, *b])))
    hits = bootstrap_hits(tagged, samples, ["subgroup"])
    aurocs = cut_lineage(resampled_macro_auroc(tagged, hits, samples, {"a": a, "b": b}, ["subgroup"]))
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("auroc")))
    per = aurocs.groupBy("subgroup", "b").agg(pick("a").alias("a"), pick("b").alias("b2")).withColumn("delta", F.col("a") - F.col("b2"))
    ends = interval(per, "delta", ["subgroup"])
    points = per.filter(F.col("b") == POINT).select("subgroup", F.col("a").alias("auroc_a"), F.col("b2").alias("auroc_b"))
    sizes = tagged.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("patients"))
    frame = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in members])).alias("subgroup"))
    out = frame.join(sizes, "subgroup", "left").join(points, "subgroup", "left").join(ends, "subgroup", "left").na.fill(0, ["n", "patients", "valid", "undefined"])
    status = F.when(F.col("n") == 0, "empty").when(F.col("point").isNull() | (F.col("valid") == 0), "undefined").otherwise("defined")
    known = lambda c: F.when(status == "defined", F.col(c)).alias(c)
    return out.select("subgroup", "n", "patients", "auroc_a", "auroc_b", known("point"), known("lower"), known("upper"), "valid", "undefined", status.alias("status"))


def weighted_confusion(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Confusion counts of every resample: (b, true, predicted, n)."""
    per = pairs.groupBy("patient_id", "true", "predicted").agg(F.count(F.lit(1)).alias("c"))
    return per.join(weights, "patient_id").groupBy("b", "true", "predicted").agg(F.sum(F.col("c") * F.col("w")).alias("n"))


def weighted_macro_auroc(pairs: DataFrame, weights: DataFrame, models: dict[str, Sequence[str]]) -> DataFrame:
    """Macro one-vs-rest AUROC of every resample and model: (b, model, auroc).

    The macro value is the mean over the grades defined in that resample, null if there is none.
    """
    entries = [
        F.struct(F.lit(m).alias("model"), F.lit(g).cast("long").alias("g"), F.col(c).alias("p"))
        for m, cols in models.items() for g, c in zip(GRADES, cols)
    ]
    long = pairs.select("patient_id", "true", F.explode(F.array(*entries)).alias("e")).select("patient_id", "true", "e.*")
    scored = long.groupBy("patient_id", "model", "g", "p").agg(
        F.sum((F.col("true") == F.col("g")).cast("long")).alias("pos"), F.sum((F.col("true") != F.col("g")).cast("long")).alias("neg")
    )
    per = scored.join(weights, "patient_id").groupBy("b", "model", "g", "p").agg(
        F.sum(F.col("pos") * F.col("w")).alias("pos"), F.sum(F.col("neg") * F.col("w")).alias("neg")
    )
    w = Window.partitionBy("b", "model", "g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    below = per.withColumn("below", F.sum("neg").over(w))
    pairs_n = F.sum("pos") * F.sum("neg")
    auc = F.when(pairs_n > 0, F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0)) / pairs_n)
    each = below.groupBy("b", "model", "g").agg(auc.alias("auroc"))
    return each.groupBy("b", "model").agg(F.avg("auroc").alias("auroc"))


def interval(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Point estimate with 2.5 and 97.5 percentiles and the numbers of defined and undefined resamples.

    The point is the value of the full set, resample ``POINT``; null when that is undefined or absent.
    """
    drawn = F.when(F.col("b") != POINT, F.col(value))
    q = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    undefined = F.count(F.when((F.col("b") != POINT) & F.col(value).isNull(), 1))
    agg = df.groupBy(*keys).agg(
        F.max(F.when(F.col("b") == POINT, F.col(value))).alias("point"), q.alias("_q"), F.count(drawn).alias("valid"), undefined.alias("undefined")
    )
    return agg.select(*keys, "point", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "valid", "undefined")


def paired_delta(aurocs: DataFrame, a: str, b: str) -> DataFrame:
    """Difference a − b of every resample; null when either is undefined."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("auroc")))
    return aurocs.groupBy("b").agg((pick(a) - pick(b)).alias("delta"))


def verdict(point: Column, lower: Column, floor: float = 0.70) -> Column:
    return F.when(lower <= 0.5, "NULL").when(point >= floor, "SIGNAL").otherwise("INCONCLUSIVE")


def fit_temperature(rows: DataFrame, probs: Sequence[str], steps: int = 801, low: float = 0.05, high: float = 20.0, floor: float = 1e-7) -> DataFrame:
    """Temperature of least mean NLL on a log-spaced grid (the first on ties): one row.

    Each task adds up its rows for all temperatures at once, so what is shuffled is a row per task and temperature.
    """
    logs = [F.log(F.greatest(F.lit(floor), F.least(F.col(p), F.lit(1.0)))) for p in probs]
    base = rows.select(F.array(*logs).alias("l"), (F.col("true") - GRADES[0]).cast("int").alias("k"))
    base = base.select("l", F.col("l")[F.col("k")].alias("own"))
    t = low * (high / low) ** (np.arange(steps) / (steps - 1.0))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, seen = np.zeros(steps), 0, False
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = True
                own = part.column("own").to_numpy(zero_copy_only=False).astype(float)
                known = ~np.asarray(part.column("own").is_null())
                l = np.array(part.column("l").to_pylist(), dtype=float)[known]
                gap = l - l.max(axis=1, keepdims=True)
                norm = sum(np.exp(gap[:, i, None] / t) for i in range(gap.shape[1]))
                total += (np.log(norm) - (own[known] - l.max(axis=1))[:, None] / t).sum(axis=0)
                n += int(known.sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(steps)), pa.array(total), pa.array(np.full(steps, n))], ["i", "s", "n"])

    sums = base.mapInArrow(add, "i bigint, s double, n bigint").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("nll"))
    at = (F.lit(low) * F.pow(F.lit(high / low), F.col("i") / F.lit(steps - 1.0))).alias("temperature")
    return sums.agg(F.min_by(F.struct(at, "nll"), F.struct("nll", "i")).alias("m")).select("m.*")


def conflicting_labels(features: DataFrame, keys: Sequence[str] = ("case_id", "instance_id")) -> DataFrame:
    return features.groupBy(*keys).agg(F.countDistinct("grade").alias("n")).filter("n > 1").select(*keys)


def best_anchor_readout(features: DataFrame, keys: Sequence[str] = ("case_id", "instance_id")) -> DataFrame:
    """The feature row of best anchor IoU per lesion (lowest row id on ties)."""
    pick = F.max_by(F.struct("row_id", "f", "grade"), F.struct("anchor_iou", -F.col("row_id")))
    return features.groupBy(*keys).agg(pick.alias("m")).select(*keys, "m.*")


def pooled_readout(features: DataFrame, keys: Sequence[str] = ("case_id", "instance_id")) -> DataFrame:
    """Mean feature vector per lesion: averaged per position, then put together again."""
    k = list(keys)
    flat = features.select(*k, "grade", F.posexplode("f").alias("i", "v"))
    mean = flat.groupBy(*k, "i").agg(F.avg("v").alias("v"), F.min("grade").alias("grade"))
    # a vector has as many entries as the feature width, so the list is bounded
    return mean.groupBy(*k).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("f"), F.min("grade").alias("grade")
    )


def oof_probe(rows: DataFrame, features: Sequence[str], folds: int, label: str = "grade", fold: str = "fold", max_iter: int = 50, reg: float = 0.0) -> DataFrame:
    """Out-of-fold class probabilities of a multinomial logistic model: median impute, scale, fit per fold.

    Every row has a fold in ``[0, folds)``, no fold is empty, and every fold's training rows hold all grades;
    anything else is an error.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    here = rows.groupBy(F.col(fold).alias("k"), F.col(label).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()  # folds x grades
    if {r["k"] for r in here} != set(range(folds)):
        raise ValueError(f"folds are {sorted({r['k'] for r in here}, key=str)}")
    if not {r["g"] for r in here} <= set(GRADES):
        raise ValueError("a row has no known grade")
    for k in range(folds):
        if {r["g"] for r in here if r["k"] != k} != {r["g"] for r in here}:
            raise ValueError(f"a grade occurs in fold {k} only")
    filled = [f"{c}_filled" for c in features]
    ready = rows.withColumn("_label", (F.col(label) - GRADES[0]).cast("double"))
    parts = []
    for k in range(folds):
        steps = Pipeline(stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
            LogisticRegression(family="multinomial", featuresCol="_x", labelCol="_label", probabilityCol="_p", maxIter=max_iter, regParam=reg),
        ])
        model = steps.fit(ready.filter(F.col(fold) != k))
        scored = model.transform(ready.filter(F.col(fold) == k)).withColumn("_a", vector_to_array("_p"))
        parts.append(scored.select(*rows.columns, *[F.col("_a")[i].alias(f"p{g}") for i, g in enumerate(GRADES)]))
    return union_all(parts)


def subgroups(rows: DataFrame, members: dict[str, Column]) -> DataFrame:
    """Rows once per subgroup they belong to, for use of ``subgroup`` as a key."""
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in members.items()]), lambda v: v.isNotNull())
    return rows.withColumn("subgroup", F.explode(tags))
