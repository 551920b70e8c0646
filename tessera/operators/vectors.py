"""D: document ids, embedding contract, exact cosine top-k, index maintenance.

Top-k search never materialises (question, document) pairs as rows and never
plans a cross join. Both sides are dealt to blocks of near vectors; blocks of one
group meet if their balls allow one of the k best scores; a task scores one block pair
with matrix products in single precision (numpy inside ``mapInArrow``), scores what can
be among the k best once more in double precision and emits exactly the k best per
question. A ranked window with ``row_number() <= k`` (planned as a
WindowGroupLimit) then merges them, so the largest group is k x blocks rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

# Fixed value: RFC 4122 DNS namespace UUID (the namespace of the document ids).
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"

# Rows of a block; scores held at once inside a task, neighbours that share one maximum, pairs scored once more at once.
BLOCK_QUESTIONS = 4096
BLOCK_DOCS = 16384
TILE_SCORES = 1 << 21
RUN = 128
RESCORED = 1 << 14
# What two sums of one pair may differ by.
SLACK = 1e-12
# Questions scored at once in double precision; a block of so few documents is scored so at once.
TILE_QUESTIONS = 256
FEW_DOCS = 1024
# Parts of the work that a core should find, if blocks of documents are few.
PARTS_PER_CORE = 8
# Vectors that pull near ones into their block, at most (they go to every task).
MOST_PIVOTS = 1024


# ------------------------------------------------------------------ D6 ----

def uuid5_dns(name) -> Column:
    """UUIDv5 in the DNS namespace, computed JVM-side; equals Python's ``uuid.uuid5``."""
    name = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
                    F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
                    F.substring(h, 21, 12))


def table_doc_id(table) -> Column:
    return uuid5_dns(F.concat(F.lit("table_"), F.col(table) if isinstance(table, str) else table))


def column_doc_id(table, column) -> Column:
    t = F.col(table) if isinstance(table, str) else table
    c = F.col(column) if isinstance(column, str) else column
    return uuid5_dns(F.concat(F.lit("column_"), t, F.lit("_"), c))


def query_doc_id(question) -> Column:
    return uuid5_dns(question)


# ------------------------------------------------------------- D3-D5 ------

def table_embedding_text() -> Column:
    """D3: name + description + keywords."""
    return F.concat_ws(" ", F.col("name"), F.coalesce(F.col("description"), F.lit("")),
                       F.array_join(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), " "))


def column_embedding_text() -> Column:
    """Name + description."""
    return F.concat_ws(" ", F.col("name"), F.coalesce(F.col("description"), F.lit("")))


# ------------------------------------------------------------------ D1 ----

def hashed_embedding(df: DataFrame, text_col: str, key_cols: list[str], dim: int = 64,
                     out_col: str = "vector") -> DataFrame:
    """Default embedder: signed feature hashing of lower-cased word tokens, L2-normalised.

    Words are split on every non-letter/digit (so ``c_custkey`` gives ``c``
    and ``custkey``).

    Pure DataFrame work: explode tokens, aggregate (key, bucket) weights, fold
    the at most ``dim`` buckets of a document into a dense array. Documents
    without tokens get a zero vector (their similarity is null, see topk).
    """
    words = F.explode(F.split(F.lower(F.col(text_col)), "[^\\p{L}\\p{N}]+"))
    # light normalisation: a trailing plural 's' is dropped from words longer than 3 letters
    tok = (df.select(*key_cols, words.alias("w")).where(F.col("w") != "")
           .select(*key_cols, F.when((F.length("w") > 3) & F.col("w").endswith("s"),
                                     F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w")).alias("t")))
    h = F.xxhash64(F.col("t"))
    w = (tok.select(*key_cols, F.pmod(h, F.lit(dim)).cast("int").alias("b"),
                    F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
         .groupBy(*key_cols, "b").agg(F.sum("s").alias("v")))
    dense = (w.groupBy(*key_cols).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
             .select(*key_cols, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                            lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("raw")))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x * x))
    dense = dense.select(*key_cols, F.transform("raw", lambda x: (x / F.nullif(norm, F.lit(0.0))).cast("float"))
                         .alias(out_col))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (df.select(*key_cols).join(dense, key_cols, "left")
            .select(*key_cols, F.coalesce(F.col(out_col), zero).alias(out_col)))


def embed_with(df: DataFrame, text_col: str, fn, dim: int, out_col: str = "vector") -> DataFrame:
    """D1/D2 contract for external models: ``fn(list[str]) -> list[list[float]]``.

    Runs inside ``mapInPandas``; Arrow batches (``maxRecordsPerBatch``) are the
    embedding batches, the model client is created once per partition by ``fn``.
    """
    from pyspark.sql import types as T

    # a new StructType: ``df.schema.add`` would mutate the frame's cached schema
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(it):
        for pdf in it:
            vecs = fn(pdf[text_col].fillna("").tolist()) if len(pdf) else []
            pdf[out_col] = [np.asarray(v, dtype=np.float32) for v in vecs]
            yield pdf

    return df.mapInPandas(run, schema)


# ------------------------------------------------------------- D17-D21 ----

def _vectors(block: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit rows (NaN for zero vectors) of one block, an array of (key, vec) structs."""
    m = _unit(block.field("vec"), dim)
    keys = block.field("key")
    return (np.array(keys.to_pylist()) if pa.types.is_string(keys.type) else keys.to_numpy(zero_copy_only=False)), m


class _Documents:
    """One block of documents in the order of their keys, without those that cannot be among the ``k`` best of any question."""

    def __init__(self, docs: pa.Array, dim: int, k: int):
        ids, d = _vectors(docs, dim)
        sound = np.flatnonzero(np.isfinite(d).all(1))
        order = sound[np.argsort(ids[sound], kind="stable")]  # positions then rank equal scores by key
        self.order = order[_of_equal(d[order], ids[order], k)]
        self.ids, self.rows, self.dim = ids[self.order], d[self.order], dim
        self.near = self.rows.astype(np.float32)
        #: no product of two unit vectors in single precision is further from the exact one
        self.error = (dim + 8) * 2.0 ** -24


def _of_equal(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that stay if of equal ones only the first k + 1 keys do (one may be a question's own), k times each."""
    n = len(rows)
    if n <= k:
        return np.arange(n)
    code = (np.ascontiguousarray(rows).view(np.uint64) * (np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(1)
    order = np.argsort(code, kind="stable")
    turn = np.append(True, code[order[1:]] != code[order[:-1]])
    starts = np.flatnonzero(turn)
    size = np.diff(np.append(starts, n))
    equal = np.logical_and.reduceat((rows[order] == rows[np.repeat(order[starts], size)]).all(1), starts)
    new = turn | np.append(True, ids[order[1:]] != ids[order[:-1]])
    number = np.cumsum(new)
    at = np.flatnonzero(new)
    spare = (number - np.repeat(number[starts], size) > k) | (np.arange(n) - np.repeat(at, np.diff(np.append(at, n))) >= k)
    return np.sort(order[~(spare & np.repeat(equal, size))])


def _block_best(questions: pa.Array, docs: _Documents, k: int, exclude_self: bool, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question number, document number, score): the k best of one block of documents, ties to the smaller key.

    ``least`` is a score per question below which nothing counts. Of a row of single-precision scores the k-th largest among
    the maxima of its runs bounds the k-th best from below; only scores within the error of that bound are computed exactly.
    """
    q, n = _unit(questions.field("vec"), docs.dim), len(docs.rows)
    asked = pc.sort_indices(questions.field("key")).to_numpy()  # sums may depend on places in the product, which the keys decide
    asked = asked[np.isfinite(q[asked]).all(1)].astype(np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    run = max(1, min(RUN, n // (4 * k)))
    runs = -(-n // run)
    few = n <= FEW_DOCS
    error = 0.0 if few else docs.error
    near = np.zeros((runs * run, docs.dim), np.float32)
    near[:n] = docs.near
    first, last = _own(questions, docs.ids) if exclude_self else (None, None)
    step = TILE_QUESTIONS if few else max(1, TILE_SCORES // max(1, len(near)))
    for at in range(0, len(asked) if n else 0, step):
        who = asked[at:at + step]
        if few:
            tile = np.full((len(who), len(near)), -np.inf)
            tile[:, :n] = q[who] @ docs.rows.T
        else:
            tile = q[who].astype(np.float32) @ near.T
            tile[:, n:] = -np.inf
        if exclude_self:
            for i in np.flatnonzero(first[who] < last[who]):
                tile[i, first[who[i]]:last[who[i]]] = -np.inf
        tops = tile.reshape(len(who), runs, run).max(2)
        need = np.partition(tops, runs - k, axis=1)[:, runs - k].astype(np.float64) - 2 * error if runs > k else np.full(len(who), -2.0)
        need = np.maximum(need, -2.0 if least is None else least[who] - error - SLACK).astype(tile.dtype)
        need = need if few else np.nextafter(need, np.float32(-3))
        i, part = np.divmod(np.flatnonzero((tops >= need[:, None]).ravel()), runs)
        for a in range(0, len(i), RESCORED):
            x, y = i[a:a + RESCORED], part[a:a + RESCORED]
            hit, col = np.divmod(np.flatnonzero((tile.reshape(len(who), runs, run)[x, y] >= need[x, None]).ravel()), run)
            x, col = x[hit], y[hit] * run + col
            found.append(_exact(who[x], col, tile[x, col] if few else _rescored(q[who], docs.rows, x, col), k, least))
    row, col, score = (np.concatenate(c) for c in zip(*found))
    keep = _k_best(row, col, score, k)
    return row[keep], docs.order[col[keep]], score[keep]


def _own(questions: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind the last of the sorted ``ids`` that equals each question's own (none for null)."""
    own = questions.field("own")
    known = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
    value = own.take(pa.array(known))
    value = np.array(value.to_pylist()) if pa.types.is_string(value.type) else value.to_numpy(zero_copy_only=False)
    first, last = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    if len(ids) and len(value):
        first[known], last[known] = np.searchsorted(ids, value, "left"), np.searchsorted(ids, value, "right")
    return first, last


def _rescored(q: np.ndarray, rows: np.ndarray, x: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Double-precision scores of pairs in the order of their questions, by matrix products of all questions and documents in them."""
    out = [np.zeros(0)]
    for a in range(0, len(x), RESCORED):
        i, j = x[a:a + RESCORED], col[a:a + RESCORED]
        low = min(int(i[0]), max(0, len(q) - 2))
        cols, at = np.unique(j, return_inverse=True)
        # at least two of each: products with a single vector are added up in another order
        out.append((q[low:max(low + 2, int(i[-1]) + 1)] @ rows[np.append(cols, cols[:1])].T)[i - low, at])
    return np.concatenate(out)


def _exact(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a question among scored pairs in the order of rows and columns."""
    some = score >= least[row] - SLACK if least is not None else np.ones(len(row), bool)
    if len(row) > RESCORED:  # many nearly equal scores: no sort of all of them
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for s, e in zip(starts, np.append(starts[1:], len(row))):
            if e - s > k:
                line = score[s:e]
                kth = np.partition(line, e - s - k)[e - s - k]
                some[s:e] &= line >= kth
                some[s + np.flatnonzero(line == kth)[k - np.count_nonzero(line > kth):]] = False
    row, col, score = row[some], col[some], score[some]
    keep = _k_best(row, col, score, k)
    return row[keep], col[keep], score[keep]


def _k_best(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the pairs that are among the k best of their row, ties to the smaller column."""
    order = np.lexsort((col, -score, row))
    start = np.searchsorted(row[order], row[order], "left")
    return order[np.arange(len(order)) - start < k]


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; NaN where a cosine is undefined."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((n > 0) & np.isfinite(n), m / n, np.nan)


def _pivots(docs: DataFrame, dim: int, blocks: int) -> np.ndarray:
    """Documents drawn by the hash of their key, twice as many as there will be blocks, at most ``MOST_PIVOTS``."""
    drawn = docs.select("m.vec", F.xxhash64("m.key").alias("h")).orderBy("h").limit(min(MOST_PIVOTS, 2 * blocks)).collect()
    unit = _unit(pa.array([r["vec"] for r in drawn], pa.list_(pa.float64())), dim)
    return unit[np.isfinite(unit).all(1)]


def _cell(pivots: np.ndarray, dim: int):
    """Number of the nearest among the first so many pivots. Null where a cosine is undefined."""
    def run(vectors: pa.Array, first: pa.Array) -> pa.Array:
        m = _unit(vectors, dim)
        near = np.nan_to_num(m) @ pivots.T
        near[np.arange(len(pivots)) >= np.asarray(first)[:, None]] = -np.inf
        return pa.array(near.argmax(1) if len(pivots) else np.zeros(len(m)), pa.int32(), mask=np.isnan(m).any(1))
    return F.arrow_udf(run, "int")


def _ball(dim: int):
    """Centre and radius of a block's unit vectors."""
    def run(blocks: pa.Array) -> pa.Array:
        out = []
        for i in range(len(blocks)):
            _, m = _vectors(blocks.slice(i, 1).flatten(), dim)
            centre = m.mean(0)
            out.append({"centre": centre.tolist(), "radius": float(np.linalg.norm(m - centre, axis=1).max())})
        return pa.array(out, pa.struct([("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))
    return F.arrow_udf(run, "centre array<double>, radius double")


def _sound(df: DataFrame, key: str, vec: str, group: str | None, dim: int, own: str | None = None) -> DataFrame:
    # floats stay floats wherever rows are moved or written; scores are computed in doubles either way
    kept = F.col(vec) if df.select(vec).dtypes[0][1] == "array<float>" else F.col(vec).cast("array<double>")
    parts = [F.col(key).alias("key"), kept.alias("vec")] + ([F.col(own).alias("own")] if own else [])
    known = df.where(F.col(vec).isNotNull() & (F.size(vec) == dim) & F.col(key).isNotNull())
    return known.select((F.col(group) if group else F.lit(0)).alias("group"), F.struct(*parts).alias("m"))


def _blocks(sound: DataFrame, dim: int, rows: int, pivots: np.ndarray, least: int) -> DataFrame:
    """(group, block, n, centre, radius, members): written blocks of at most about ``rows`` near vectors of one group.

    A group of more than ``least`` rows is dealt to the nearest of as many pivots as blocks of ``least`` rows would need; a
    cell of more than ``rows`` is cut again by the hash of the key.
    """
    sizes = sound.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.when(F.col("n") > least, F.least(2 * F.ceil(F.col("n") / least), F.lit(max(1, len(pivots))))).otherwise(1).cast("int")
    wanted = sizes.select(F.col("group").alias("_g"), wanted.alias("first"))
    placed = sound.join(wanted, sound["group"].eqNullSafe(wanted["_g"])).select("group", "m", _cell(pivots, dim)(F.col("m.vec"), F.col("first")).alias("cell"))
    placed = materialize(placed.where("cell IS NOT NULL"), "placed")
    cells = placed.groupBy("group", "cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    cells = cells.select(F.col("group").alias("_g"), F.col("cell").alias("_c"), "parts")
    dealt = placed.join(cells, placed["group"].eqNullSafe(cells["_g"]) & (placed["cell"] == cells["_c"]))
    block = F.col("cell").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("m.key"), F.col("parts"))
    held = (dealt.select("group", block.alias("block"), "m").groupBy("group", "block")
            .agg(F.count(F.lit(1)).alias("n"), F.collect_list("m").alias("members")))
    held = held.withColumn("ball", _ball(dim)(F.col("members")))
    return materialize(held.select("group", "block", "n", "ball.centre", "ball.radius", "members"), "blocks")


def _score(pairs: DataFrame, dim: int, k: int, own: bool, qkey_type: str, key_type: str) -> DataFrame:
    """(q, id, score, ask) of the k best documents per question in every (group, block, ask, asks, members) pair of blocks.

    A column ``known`` holds (q, s) of questions of which scores below s are of no use. Pairs with one block of documents lie together.
    """
    bounded = "known" in pairs.columns

    def run(batches):
        held, docs = None, None
        for batch in batches:
            group, block, ask, asks, members = batch.columns[:5]
            for r in range(batch.num_rows):
                one, two = (c.slice(r, 1).flatten() for c in (asks, members))
                if docs is None or held != (group[r].as_py(), block[r].as_py()):
                    held, docs = (group[r].as_py(), block[r].as_py()), _Documents(two, dim, k)
                least = None
                if bounded:
                    known = batch.column(5).slice(r, 1).flatten()
                    at = pc.index_in(one.field("key"), known.field("q"))
                    least = known.field("s").take(at).fill_null(-2.0).to_numpy(zero_copy_only=False)
                i, j, score = _block_best(one, docs, k, own, least)
                yield pa.RecordBatch.from_arrays([one.field("key").take(pa.array(i, pa.int64())), two.field("key").take(pa.array(j, pa.int64())), pa.array(score, pa.float64()),
                                                  pa.array(np.full(len(i), ask[r].as_py()), pa.int64())], names=["q", "id", "score", "ask"])

    return pairs.select("group", "block", "ask", "asks", "members", *(["known"] if bounded else [])).mapInArrow(run, f"q {qkey_type}, id {key_type}, score double, ask bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_cosine(questions: DataFrame, docs: DataFrame, k: int, *, q_key: str = "question_id",
                q_vec: str = "qvec", doc_key: str = "id", doc_vec: str = "vector",
                q_group: str | None = None, doc_group: str | None = None, q_self: str | None = None, dim: int | None = None,
                block_questions: int = BLOCK_QUESTIONS, block_docs: int = BLOCK_DOCS, counter: dict | None = None) -> DataFrame:
    """Exact cosine top-k documents per question: (q_key, doc_key, similarity_score, rank).

    Questions and documents lie in blocks of near vectors of one group. A directory (one row per block: group, centre,
    radius, size) is joined on the group first, so a question block meets blocks of its own group only, and only numbers
    are copied. No vector of a block is nearer to one of another than their centres' distance less both radii: the
    blocks that can be nearest are searched first, and of the others only those whose bound reaches the k-th best score
    that some question of the block has by then. ``counter`` takes the numbers of ``pairs`` and of those ``scored``.
    An index that fits one block has no directory. ``q_group``/``doc_group`` restrict a question to documents of its group
    (D17/D20). ``q_self`` names a question column holding a document id that must not match itself. Ties are
    broken by document id, also inside a block; zero vectors never match; vectors of another length than
    ``dim`` (by default the questions' longest) take no part. No question passes the driver.
    """
    spark = questions.sparkSession
    key_type, qkey_type = dict(docs.dtypes)[doc_key], dict(questions.dtypes)[q_key]
    dim = dim or questions.agg(F.max(F.size(q_vec))).first()[0]
    if not dim or dim < 0:
        return spark.createDataFrame([], f"{q_key} {qkey_type}, {doc_key} {key_type}, similarity_score double, rank int")
    asked, held = _sound(questions, q_key, q_vec, q_group, dim, q_self), _sound(docs, doc_key, doc_vec, doc_group, dim)
    score = lambda pairs: _score(pairs, dim, k, q_self is not None, qkey_type, key_type)
    n = held.count()
    if n <= block_docs:
        dealt = lambda parts: F.pmod(F.xxhash64("m.key"), F.lit(parts))
        d = held.groupBy("group", dealt(1).alias("block")).agg(F.collect_list("m").alias("members"))
        ask = dealt(max(1, -(-asked.count() // block_questions))).alias("ask")
        q = asked.groupBy("group", dealt(1).alias("block"), ask).agg(F.collect_list("m").alias("asks"))
        found = score(_meet(q, d, 1))  # an equi-join on the block's number, also where there is one group
    else:
        pivots = _pivots(held, dim, -(-n // block_docs))
        found = _pruned(_blocks(asked, dim, block_questions, pivots, 1), _blocks(held, dim, block_docs, pivots, block_docs), score, k, counter)
    return _best(found, k).select(F.col("q").alias(q_key), F.col("id").alias(doc_key),
                                  F.col("score").alias("similarity_score"), F.col("rank").cast("int").alias("rank"))


def _meet(q: DataFrame, d: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``q`` with their block of documents. With few blocks each goes to several tasks, between which the rows are dealt by ``ask``."""
    turns = max(1, -(-PARTS_PER_CORE * q.sparkSession.sparkContext.defaultParallelism // blocks))
    return (q.withColumn("turn", F.pmod(F.xxhash64("ask"), F.lit(turns)).cast("int"))
            .join(d.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))), ["group", "block", "turn"]))


def _pruned(q: DataFrame, d: DataFrame, score, k: int, counter: dict | None) -> DataFrame:
    """Candidates from the pairs of blocks that can hold one of the k best documents of a question."""
    number = F.xxhash64("group", "block").alias("ask")  # two blocks that shared a number would only lower each other's bound
    q = q.select(number, "group", F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"),
                 F.col("members").alias("asks"))
    near = q.drop("asks").join(d.drop("members"), "group")
    apart = F.sqrt(F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
    least = F.greatest(F.lit(0.0), apart - F.col("q_radius") - F.col("radius"))
    w = Window.partitionBy("group", "q_block").orderBy(F.desc("bound"), F.asc("block"))
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("bound", 1 - least * least / 2).withColumn("first", F.coalesce(before, F.lit(0)) < k + 1)
    near = materialize(near.select("ask", "group", "q_block", "q_n", "block", "bound", "first"), "pairs")
    members, asks, blocks = d.select("group", "block", "members"), q.select("group", "q_block", "asks"), max(1, d.count())
    whole = lambda pairs, asks: score(_meet(pairs.join(asks, ["group", "q_block"]), members, blocks))
    one = materialize(whole(near.where("first"), asks), "found")
    # the k-th best score of every question, which its other candidates must reach; a block's least one is what another block must reach
    kth = _best(one, k).groupBy("ask", "q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    kth = kth.groupBy("ask").agg(F.count(F.lit(1)).alias("found"), F.min(F.when(F.col("n") >= k, F.col("s")).otherwise(-2.0)).alias("s"),
                                 F.collect_list(F.when(F.col("n") >= k, F.struct("q", "s"))).alias("known"))
    kth = materialize(kth, "kth")
    todo = near.where("not first").join(kth.drop("known"), "ask", "left")
    reach = F.when(F.col("found") == F.col("q_n"), F.col("s")).otherwise(-2.0)  # a question without k documents takes any
    todo = materialize(todo.where(F.col("bound") >= reach - 1e-9).select("ask", "group", "q_block", "block"), "pairs")
    asks = q.select("group", "q_block", "asks", "ask").join(kth.select("ask", "known"), "ask", "left").drop("ask")
    if counter is not None:
        counter["pairs"], counter["scored"] = near.count(), near.where("first").count() + todo.count()
    return one.unionByName(whole(todo, asks))


def centroids(docs: DataFrame, group: str, vec: str = "vector") -> DataFrame:
    """Mean vector per group, element-wise, as a two-level aggregate (posexplode + groupBy)."""
    e = docs.select(group, F.posexplode(vec).alias("i", "x"))
    m = e.groupBy(group, "i").agg(F.avg("x").alias("x"))
    return (m.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
            .select(group, F.transform("l", lambda s: s["x"].cast("float")).alias(vec)))


# ------------------------------------------------------------ D7-D16 ------

def upsert(index: DataFrame, batch: DataFrame, key: str = "id", order_col: str | None = None) -> DataFrame:
    """Insert or replace by id, one row per id.

    Of equal ids in a batch the last by ``order_col`` wins, without one (and among ties) the largest row.
    """
    row = F.struct(*index.columns)
    best = F.max_by(row, F.struct(F.col(order_col), row)) if order_col else F.max(row)
    batch = batch.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*").select(*index.columns)
    return index.join(batch.select(key), key, "left_anti").unionByName(batch)


def delete_ids(index: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """D10."""
    return index.join(ids.select(key).distinct(), key, "left_anti")


def update_vectors(index: DataFrame, new: DataFrame, key: str = "id", vec: str = "vector") -> DataFrame:
    """Replace vectors of listed ids, payload unchanged."""
    n = new.select(key, F.col(vec).alias("_new")).dropDuplicates([key])
    return (index.join(n, key, "left")
            .withColumn(vec, F.coalesce(F.col("_new"), F.col(vec))).drop("_new")
            .select(*index.columns))


def dimension_check(index: DataFrame, dim: int, vec: str = "vector", by: str = "type") -> DataFrame:
    """A10: per type, document count and whether every vector has the index dimension."""
    return index.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.min(F.size(vec)).cast("bigint").alias("min_dim"), F.max(F.size(vec)).cast("bigint").alias("max_dim"),
        F.bool_and(F.size(vec) == dim).alias("dim_ok"))


def exists_by(index: DataFrame, probes: DataFrame, on: list[str]) -> DataFrame:
    """Probes with a boolean `exists` column (left semi join as a flag)."""
    hit = index.select(*on).distinct().withColumn("exists", F.lit(True))
    return probes.join(hit, on, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def exact_match(questions: DataFrame, stored: DataFrame, q_text: str = "question",
                s_text: str = "question") -> DataFrame:
    """Equi-join on the question's UUIDv5 id; the stored side is deduplicated first.

    Among stored rows with the same question the smallest struct wins, so
    the first stored column decides (e.g. the oldest id).
    """
    s = stored.withColumn("_qid", query_doc_id(s_text))
    s = s.groupBy("_qid").agg(F.min(F.struct(*stored.columns)).alias("m"))
    q = questions.withColumn("_qid", query_doc_id(q_text))
    return q.join(s, "_qid", "left").withColumn("exact_match", F.col("m").isNotNull()).drop("_qid")
