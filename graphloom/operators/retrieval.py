"""Ranked retrieval: BM25, cosine neighbours, rank fusion, boosts and caps. All queries are answered in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, BOOST, EDGE_CAP = 60, 0.15, 2
#: Queries of a block, documents and vectors scored at once, and weights of query terms that the driver may hold.
QUERY_BLOCK, DOC_BLOCK, VECTOR_BLOCK, MOST_WEIGHTS = 512, 512, 2048, 4_000_000
#: Documents whose words are counted at once, and vectors, or queries, that a group holds, about.
COUNT_BLOCK, SIDE = 2048, 16_384
#: Columns of packed vectors, and of packed queries.
MATRIX = ("ids", "labels", "dim", "data")
QUERY_COLUMNS = tuple(f"q_{c}" for c in MATRIX)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script and underscores, of two characters or more. A text without
    any gives its runs of ASCII letters, digits and the signs + # ."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1)
    signs = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9+#.]+"), 0), lambda w: F.length(w) > 1)
    return F.when(F.size(words) > 0, words).otherwise(signs)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, where their files have fewer splits than that; a large table stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def with_words(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and the tokens of each text as words: ``tokens`` in steps, so that each part is evaluated once."""
    low = rows.select(*keys, F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    split = low.select(*keys, "low", F.filter(F.split("low", r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1).alias("words"))
    signs = F.filter(F.regexp_extract_all("low", F.lit("[a-z0-9+#.]+"), 0), lambda w: F.length(w) > 1)
    return split.select(*keys, F.when(F.size("words") > 0, F.col("words")).otherwise(signs).alias("words"))


def counting() -> Callable:
    """A function that is sent to tasks as a whole, so that workers need not find this module."""

    def term_counts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The different words of each list: the list, the word's place in the last result and how often the list has it, list by
        list; the lengths of the lists; and the words."""
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = lists.flatten().dictionary_encode()
        size = max(1, len(codes.dictionary))
        pairs, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + codes.indices.to_numpy(), return_counts=True)
        return pairs // size, pairs % size, tf, lengths, codes.dictionary

    return term_counts


def term_weights(docs: DataFrame, queries: DataFrame) -> tuple[list, float]:
    """(query_id, term, weight) of the terms of a stated query set, and the mean length of a document. A weight is the
    idf over all documents times how often the query has the term. A negative idf becomes EPSILON times the mean idf
    over the vocabulary. One pass over the texts counts documents by term, and under a null term all of them."""
    term_counts = counting()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """term, df, dl: how many documents of a block (words) have a term; a null term counts documents and words."""
        for batch in batches:
            for begin in range(0, batch.num_rows, COUNT_BLOCK):
                _, term, _, lengths, words = term_counts(batch.slice(begin, COUNT_BLOCK).column(0))
                df = np.append(np.bincount(term, minlength=len(words)), len(lengths))
                dl = np.append(np.zeros(len(words), np.int64), lengths.sum())
                yield pa.RecordBatch.from_arrays([pa.array([*words.to_pylist(), None], pa.string()), pa.array(df, pa.int64()), pa.array(dl, pa.int64())], ["term", "df", "dl"])

    blocks = with_words(docs).mapInArrow(frequencies, "term string, df long, dl long")
    counts = blocks.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))
    counts = counts.persist()
    try:
        n, total = counts.filter("term is null").select("df", "dl").first() or (0, 0)
        idf = counts.filter("term is not null").select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = idf.agg(F.coalesce(F.avg("raw"), F.lit(0.0))).first()[0]
        asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        weights = asked.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.when(F.col("raw") < 0, mean * EPSILON).otherwise(F.col("raw"))).alias("weight"))
        return weights.limit(MOST_WEIGHTS + 1).collect(), total / max(n, 1)
    finally:
        counts.unpersist()


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, n_terms, score: for each query (query_id, text) at least the ``k`` documents of the highest
    scores and the ``k`` that share most terms with it, ties by doc_id, of all that share a term and score above 0.

    A task scores its documents in blocks against all queries by a matrix product and keeps the best of each query, so
    no posting and no pair of a query and a document is shuffled but those. The queries are a stated set: their term
    weights are held by the driver up to ``MOST_WEIGHTS``; a larger set is to be asked in parts."""
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    weights, mean_length = term_weights(docs, queries)
    if len(weights) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} query terms: ask the queries in parts")
    kind, id_type = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    terms, ids = {t: i for i, t in enumerate(sorted({w.term for w in weights}))}, sorted({w.query_id for w in weights})
    at = {q: i for i, q in enumerate(ids)}
    blocks = []
    for begin in range(0, len(ids), QUERY_BLOCK):
        table = np.zeros((len(terms), len(ids[begin : begin + QUERY_BLOCK])), np.float64)
        for w in weights:
            if begin <= at[w.query_id] < begin + QUERY_BLOCK:
                table[terms[w.term], at[w.query_id] - begin] = w.weight
        rows = np.flatnonzero(table.any(axis=1))
        blocks.append((begin, rows, table[rows]))
    shared = docs.sparkSession.sparkContext.broadcast((list(terms), ids, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, blocks = shared.value
        vocabulary, has = pa.array(terms, pa.string()), [(table != 0).astype(np.float64) for _, _, table in blocks]
        best: dict[tuple[int, int], tuple] = {}
        # the last of the k best so far of each query, by score and by shared terms: a document has to come before it
        worst, last = np.full((2, len(ids)), -np.inf), np.full((2, len(ids)), np.iinfo(np.int64).max)

        def score(keys: np.ndarray, texts: pa.ListArray) -> None:
            lengths = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), lengths)
            term = pc.index_in(texts.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            owner, term = owner[term >= 0], term[term >= 0]
            tf = np.bincount(owner * len(terms) + term, minlength=len(texts) * len(terms)).astype(np.float64).reshape(len(texts), len(terms))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[:, None] / max(mean_length, 1e-9)))
            for (begin, rows, table), held in zip(blocks, has, strict=True):
                scores, hits = np.round(part[:, rows] @ table, 4), (tf[:, rows] > 0).astype(np.float64) @ held
                found, queries = (hits > 0) & (scores > 0), slice(begin, begin + table.shape[1])
                for kept, lead in ((0, scores), (1, hits)):
                    ahead = found & ((lead > worst[kept, queries]) | ((lead == worst[kept, queries]) & (keys[:, None] < last[kept, queries])))
                    for q in np.flatnonzero(ahead.any(axis=0)):
                        more = np.flatnonzero(ahead[:, q])
                        old = best.get((begin + q, kept), (np.empty((0, 2)), keys[:0]))
                        values, names = np.concatenate([old[0], np.column_stack([scores[more, q], hits[more, q]])]), np.concatenate([old[1], keys[more]])
                        first = np.lexsort((names, -values[:, kept]))[:k]
                        best[begin + q, kept] = values[first], names[first]
                        if len(first) == k:
                            worst[kept, begin + q], last[kept, begin + q] = values[first[-1], kept], names[first[-1]]

        for batch in batches:
            for begin in range(0, batch.num_rows if terms else 0, DOC_BLOCK):
                part = batch.slice(begin, DOC_BLOCK)
                score(part.column(0).to_numpy(zero_copy_only=False), part.column(1))
        for (q, kept), (values, names) in best.items():
            seen = set(best[q, 0][1].tolist()) if kept else set()
            rows = [i for i in range(len(names)) if names[i] not in seen]
            columns = [pa.array([ids[q]] * len(rows), id_type), pa.array([int(names[i]) for i in rows], pa.int64()), pa.array([int(values[i, 1]) for i in rows], pa.int64()), pa.array([float(values[i, 0]) for i in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "n_terms", "score"])

    split = with_words(docs.filter("doc_id is not null"), "doc_id")
    return split.mapInArrow(run, f"query_id {kind}, doc_id long, n_terms long, score double")


def two_lists(scores: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank, arm: the ``k`` first of each query by score (arm 0) and by shared terms (arm 1), ties by
    doc_id. Both ranks are found in one plan, so the scores are computed once."""
    places = [F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "doc_id")) for c in ("score", "n_terms")]
    placed = scores.select("query_id", "doc_id", *(p.alias(f"place{i}") for i, p in enumerate(places)))
    arms = F.array(*(F.struct(F.col(f"place{i}").alias("rank"), F.lit(i).alias("arm")) for i in range(2)))
    return placed.select("query_id", "doc_id", F.inline(arms)).filter(F.col("rank") <= k)


def top_k(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    """rank from 1 within each query; ties by doc_id."""
    window = Window.partitionBy("query_id").orderBy(*order, "doc_id")
    return scores.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for zero vectors or different lengths."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def matrices(rows: DataFrame, block: int) -> DataFrame:
    """The unit vectors of ``rows`` (vec_id, embedding, label), ``block`` to a row: ids, labels, dim, data (doubles).
    Vectors of different length are in different rows; a zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, block) for b in batches for i in range(0, b.num_rows, block)):
            dims = np.array([len(v) if v is not None else 0 for v in batch.column(1).to_pylist()])
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for begin in range(0, len(mine), block):
                    part = batch.take(pa.array(mine[begin : begin + block]))
                    x = np.nan_to_num(np.array([v or [] for v in part.column(1).to_pylist()], np.float64).reshape(part.num_rows, int(dim)))
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], longs), pa.array([part.column(2).to_pylist()], longs), pa.array([int(dim)], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "labels", "dim", "data"])

    longs = pa.list_(pa.int64())
    chosen = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    return chosen.mapInArrow(run, "ids array<long>, labels array<long>, dim int, data binary")


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, embedding, label) for each row of a stated query set of the same
    columns: cosine in double precision, rounded to 4 digits, ties by id; 0 for zero vectors and other lengths. Matrices of
    queries and of vectors are dealt to groups, and leave the best of each query: a task holds one group of about ``SIDE``
    vectors and as many queries at a time, however many there are. A query is not its own neighbour."""

    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for q_ids, q_labels, q_dim, q_data in zip(*(asked.column(c) for c in QUERY_COLUMNS), strict=True):
            q_ids, q_labels, q_dim, queries = np.array(q_ids.as_py()), q_labels.as_py(), q_dim.as_py(), np.frombuffer(q_data.as_py())
            for ids, labels, dim, data in zip(*(held.column(c) for c in MATRIX), strict=True):
                ids, labels, dim = np.array(ids.as_py()), labels.as_py(), dim.as_py()
                if dim == q_dim and dim:
                    scores = queries.reshape(-1, dim) @ np.frombuffer(data.as_py()).reshape(-1, dim).T
                else:
                    scores = np.zeros((len(q_ids), len(ids)))
                scores = np.where(q_ids[:, None] == ids[None, :], -2, np.round(scores, 4) + 0.0)
                first = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q_ids)), first.shape[1])
                column = first.ravel()
                good = scores[row, column] > -2
                row, column = row[good], column[good]
                out.append(pa.table([pa.array(q_ids[row], pa.int64()), pa.array([q_labels[r] for r in row], pa.int64()), pa.array(ids[column], pa.int64()), pa.array([labels[c] for c in column], pa.int64()), pa.array(scores[row, column])], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.float64())], names)

    names = ["query_id", "query_label", "doc_id", "label", "score"]
    blocks, sides = (max(1, -(-rows.count() // SIDE)) for rows in (vectors, queries))
    place = F.xxhash64(F.col("ids")[0], "dim")
    each = {c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for c, n in (("block", blocks), ("side", sides))}
    left = matrices(vectors, VECTOR_BLOCK).select(F.pmod(place, F.lit(blocks)).cast("int").alias("block"), each["side"], *MATRIX)
    right = matrices(queries, QUERY_BLOCK).select(each["block"], F.pmod(place, F.lit(sides)).cast("int").alias("side"), *(F.col(c).alias(q) for c, q in zip(MATRIX, QUERY_COLUMNS, strict=True)))
    met = left.groupBy("block", "side").cogroup(right.groupBy("block", "side"))
    return top_k(met.applyInArrow(run, "query_id long, query_label long, doc_id long, label long, score double"), k, F.desc("score"))


def rrf(first: DataFrame, second: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, rank). Ties: the first list's order, then the second's."""
    return fused(first.select("query_id", "doc_id", "rank", F.lit(0).alias("arm")).unionByName(second.select("query_id", "doc_id", "rank", F.lit(1).alias("arm"))), k, rrf_k)


def fused(arms: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """``rrf`` of lists that lie in one table (query_id, doc_id, rank, arm)."""
    summed = arms.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("arm", "rank")).alias("first")
    )
    ranked = top_k(summed, k, F.desc("score"), F.col("first.arm"), F.col("first.rank"))
    return ranked.select("query_id", "doc_id", "rank", "score")


def boosted(ranked: DataFrame, relevant: DataFrame, k: int, boost: float = BOOST) -> DataFrame:
    """Adds ``boost`` to the documents in ``relevant`` (doc_id) and orders anew; equal scores keep their order."""
    flagged = ranked.join(relevant.select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left")
    scored = flagged.withColumn("score", F.round(F.col("score") + F.coalesce("hit", F.lit(0)) * boost, 9)).withColumn("before", F.col("rank")).drop("rank")
    return top_k(scored, k, F.desc("score"), F.col("before")).select("query_id", "doc_id", "rank", "score")


def capped(ranked: DataFrame, is_edge: Column, k: int, cap: int = EDGE_CAP) -> DataFrame:
    """Walks each list in order and keeps at most ``cap`` edge documents, until ``k`` are kept. A negative cap is none."""
    if cap >= 0:
        seen = F.sum(is_edge.cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
        ranked = ranked.withColumn("__seen", seen).filter(~is_edge | (F.col("__seen") <= cap)).drop("__seen")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("new_rank", again).filter(F.col("new_rank") <= k)


def expanded_query(texts: DataFrame, found: DataFrame, caps: dict[str, int]) -> DataFrame:
    """query_id, expanded: each text (doc_id, text) and, after it, the distinct names whose alias it holds (``found``:
    doc_id, kind, alias, canonical): by kind, the longest aliases first, no more of a kind than ``caps`` says."""
    cap = F.lit(0)
    for kind, most in caps.items():
        cap = F.when(F.col("kind") == kind, most).otherwise(cap)
    order = Window.partitionBy("doc_id", "kind").orderBy(F.desc(F.length("alias")), "alias", "canonical")
    first = found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= cap)
    names = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rn", "canonical"))).alias("n"))
    names = names.select("doc_id", F.array_join(F.array_distinct(F.transform("n", lambda x: x["canonical"])), " | ").alias("n"))
    joined = texts.select("doc_id", "text").join(names, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("query_id"), F.when(F.col("n").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "text", "n")).alias("expanded"))


def doc_key(chunk_id: Column, doc_id: Column, canonical_id: Column, text: Column) -> Column:
    """What a document is known by: its chunk, document or canonical id, else the first 120 characters of its text."""

    def filled(c: Column) -> Column:
        return F.nullif(F.trim(c.cast("string")), F.lit(""))

    return F.coalesce(filled(chunk_id), filled(doc_id), filled(canonical_id), F.substring(F.coalesce(text, F.lit("")), 1, 120))


def vector_arm(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The hits (query_id, doc_id, rank) whose document (doc_id, text) has a text, ranked anew."""
    good = texts.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    return hits.join(good, "doc_id", "left_semi").withColumn("rank", rank)


def retrieve(vector: DataFrame, lexical: DataFrame | None, relevant: DataFrame | None, is_edge: Column, edges: DataFrame, k: int, pool: int = 60, cap: int = EDGE_CAP) -> DataFrame:
    """Both arms (query_id, doc_id, rank; the vector arm with score) fused, boosted and capped. Without a lexical arm, or
    for a query that has no lexical hit, the vector arm keeps its own scores. ``edges``: doc_id and the columns of ``is_edge``."""
    first = vector.filter(F.col("rank") <= pool)
    if lexical is None:
        ranked = first.select("query_id", "doc_id", "rank", "score")
    else:
        second = lexical.filter(F.col("rank") <= pool)
        fused = rrf(first, second, 2 * pool)
        asked = second.select("query_id").distinct()
        ranked = fused.join(asked, "query_id", "left_semi").unionByName(first.select("query_id", "doc_id", "rank", "score").join(asked, "query_id", "left_anti"))
    if relevant is not None:
        ranked = boosted(ranked, relevant, 2 * pool)
    marked = ranked.join(edges, "doc_id", "left")
    return capped(marked, F.coalesce(is_edge, F.lit(False)), k, cap).select("query_id", "doc_id", F.col("new_rank").alias("rank"), "score")


#: The name space of domain names, and the relation types that have documents of their own.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
EDGE_TYPES = ("BUILT_ON", "VALIDATES", "REQUIRES")


def name_uuid(kind: Column, key: Column) -> Column:
    """The version 5 UUID of "kind:key" among domain names."""
    data = F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(F.concat_ws(":", kind, key.cast("string")), "utf-8"))
    digest = F.sha1(data)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def edge_documents(relation: DataFrame, competency: DataFrame) -> DataFrame:
    """edge_id, rel_type, text of the relations that are searched as documents of their own."""
    names = competency.select("item_code", "item_name")
    rows = relation.filter(F.col("rel_type").isin(*EDGE_TYPES))
    named = rows.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst")
    key = F.concat_ws(":", F.col("src").cast("string"), "rel_type", F.col("dst").cast("string"))
    return named.select(name_uuid(F.lit("edge"), key).alias("edge_id"), "src", "rel_type", "dst", F.concat_ws(" ", "src_name", F.lower(F.replace("rel_type", F.lit("_"), F.lit(" "))), "dst_name").alias("text"))


def seed_codes(hits: DataFrame) -> DataFrame:
    """query_id, kind, place, code: the codes that hits (query_id, rank, doc_type, code, items) stand for, in their order
    and once each. A course stands for the competencies it teaches too; other kinds of documents for nothing."""
    own = F.when(F.col("doc_type").isin("career", "competency", "course"), F.array(F.struct(F.col("doc_type").alias("kind"), F.trim("code").alias("code"), F.lit(0).alias("at"))))
    taught = F.when(F.col("doc_type") == "course", F.transform("items", lambda c, i: F.struct(F.lit("competency").alias("kind"), F.trim(c).alias("code"), (i + 1).alias("at"))))
    empty = F.array().cast("array<struct<kind: string, code: string, at: int>>")
    rows = hits.select("query_id", "rank", F.explode(F.concat(F.coalesce(own, empty), F.coalesce(taught, empty))).alias("x")).select("query_id", "rank", "x.*").filter("code <> ''")
    first = rows.groupBy("query_id", "kind", "code").agg(F.min(F.struct("rank", "at")).alias("first"))
    return first.select("query_id", "kind", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("first", "code")).alias("place"), "code")


#: The eight runs of a half factorial, as vector seed, graph rerank, BM25 and query expansion.
FACTORIAL = (
    (True, True, True, True), (True, True, True, False), (True, True, False, True), (True, False, True, True),
    (True, False, False, False), (False, True, True, False), (False, True, False, True), (False, False, True, True),
)


def factorial_runs(arms: DataFrame, relevant: DataFrame, k: int, boost: float = BOOST) -> DataFrame:
    """config, query_id, rank, doc_id, score of each run, all in one pass. ``arms``: query_id, doc_id, rank, lexical,
    expanded (whether the query was); ``relevant``: doc_id, by_seed (relevant only by way of a vector seed)."""
    rows = [(f"F1{a:d}_F2{b:d}_F3{c:d}_F4{d:d}", a, b, c, d) for a, b, c, d in FACTORIAL]
    configs = arms.sparkSession.createDataFrame(rows, "config string, seed boolean, rerank boolean, bm25 boolean, expand boolean")
    mine = arms.join(F.broadcast(configs), (F.col("expanded") == F.col("expand")) & (~F.col("lexical") | F.col("bm25")))
    first = F.min(F.struct("lexical", "rank")).alias("first")
    fused = mine.groupBy("config", "seed", "rerank", "query_id", "doc_id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), first)
    flags = relevant.groupBy("doc_id").agg(F.min("by_seed").alias("by_seed"))
    lifted = F.col("rerank") & F.col("by_seed").isNotNull() & (~F.col("by_seed") | F.col("seed"))
    scored = fused.join(flags, "doc_id", "left").withColumn("score", F.round(F.col("score") + F.when(lifted, boost).otherwise(0.0), 9))
    order = Window.partitionBy("config", "query_id").orderBy(F.desc("score"), "first.lexical", "first.rank", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("config", "query_id", "rank", "doc_id", "score")
