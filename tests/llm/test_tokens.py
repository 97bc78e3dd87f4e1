"""Operators 4, 6 and 10: token ids against the libraries, and exact round trips."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, packing, token_files, tokens

LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, part int, ids string"


def odd_texts(n):
    rng = random.Random(4)
    letters = "ab \n\t  é漢字'1,.!’\x1c\x85 xyz's'll😀<|endoftext|>"
    fixed = ["", " ", "  ", "\n", " a", "a ", "a\n b", "a \nb", "word " * 50, "x" * 3000, "it's we'll", "a\r\n\r\nb", " b"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(LIBRARY)
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_ranks(RANKS)


@pytest.fixture(scope="module")
def table(vocabulary):
    return bpe.PerfectHash(vocabulary)


def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary, table):
    assert sorted(table.slots) == list(range(len(vocabulary)))
    assert all(table.find(t) == i for i, t in enumerate(vocabulary))


def test_bytes_merge_as_the_library(vocabulary, table):
    texts = odd_texts(2000)
    cache = tokens.PieceCache(bpe.TextEncoder(bpe.ByteBpe(vocabulary, table, limit=50), public_tokenizers.PATTERN), limit=40)
    decode = bpe.Decoder(vocabulary)
    for text, got, want in zip(texts, cache.encode(texts), reference(vocabulary).encode_ordinary_batch(texts), strict=True):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == want, text
        assert decode(ids) == text.encode()


def test_pieces_join_to_the_library_ids(library):
    texts = odd_texts(2000)
    cache = tokens.PieceCache(tokens.LibraryEncoder(LIBRARY, limit=50), limit=40)
    for text, got, want in zip(texts, cache.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def rows_of(texts):
    return [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, None, 1, None), (None, "no id", 2, "y"), (5, "again", 0, ""), (5, "again", 0, "")]


def test_added_tokens_are_the_library_ids():
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>\n" * 30, "<|endoftext|", "one two", "x <|endoftext|><|endoftext|> y " * 20]
    cache, library = tokens.library_cache(LIBRARY), Tokenizer.from_file(LIBRARY)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in cache.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [505, 220, 50256, 734]


def test_cached_words_and_mapped_words_do_not_meet():
    library = Tokenizer.from_file(LIBRARY)
    for texts in (["(número)", "nÃºmero", "(você)", "vocÃª x", "a (b", "Ġ(", "Ġb"], ["nÃºmero", "(número)", "vocÃª x", "(você)", "Ġb", "a\tb b's", " b"]):
        encoder = tokens.LibraryEncoder(LIBRARY)
        for text in texts:
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(tokens.PieceCache(encoder).encode([text])[0], "<u4").tolist() == want, text


def test_encode_documents(spark, vocabulary):
    rows = rows_of(odd_texts(60))
    got = bpe.encode_documents(spark.createDataFrame(rows, DOCS), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, _, _ in rows:
        ids = reference(vocabulary).encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((str(doc_id), len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest(), ids, (text or "").encode()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, bytes(r.decoded)) for r in got) == sorted(want)


def test_token_files(spark, library, tmp_path):
    rows = rows_of(odd_texts(60))
    path = str(tmp_path / "files")
    token_files.write_token_files(spark.createDataFrame(rows, DOCS).repartition(5), path, LIBRARY, end_id=2, partitions=4)
    stored = token_files.read_token_files(spark, path)
    got = sorted(token_files.token_digests(stored).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    ids_of = {(str(d), t or ""): [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _, _ in rows}
    at, left = 0, sorted((str(k[0]), len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in ((k, ids_of[k]) for k in [(str(d), t or "") for d, t, _, _ in rows]))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == left
    found = token_files.find_documents(spark, path, [7]).collect()
    assert [r.doc_id for r in found] == [7] and found[0].ids == ids_of["7", rows[7][1]]


def test_token_files_have_stripe_indexes_and_bloom_filters(spark, tmp_path):
    path = str(tmp_path / "indexed")
    rows = [(2 * k, "a few words", 0, "x") for k in range(9000)]
    token_files.write_token_files(spark.createDataFrame(rows, DOCS), path, LIBRARY, end_id=2, partitions=1)
    java, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = next(str(p) for p in (tmp_path / "indexed").glob("*.orc"))
    reader = java.org.apache.orc.OrcFile.createReader(java.org.apache.hadoop.fs.Path(file), java.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 2000 and reader.getNumberOfRows() == 9000 and reader.getStripes().size() >= 1
    columns = spark.sparkContext._gateway.new_array(java.boolean, 7)
    columns[1] = True
    index = reader.rows().readRowIndex(0, None, columns)
    entries, filters = index.getRowGroupIndex()[1], index.getBloomFilterIndex()[1]
    assert entries.getEntryCount() == filters.getBloomFilterCount() == 5

    def rows_scanned(doc_id):
        found = spark.read.schema(token_files.FILE_SCHEMA).orc(path).filter(F.col("doc_id") == doc_id)
        n, leaves = len(found.collect()), found._jdf.queryExecution().executedPlan().collectLeaves()
        return n, leaves.head().metrics().get("numOutputRows").get().value()

    assert rows_scanned(8000) == (1, 2000)  # one row group of five
    # ids that no document has lie between those there are: only their Bloom filters tell
    assert sum(rows_scanned(k)[1] for k in range(4001, 4021, 2)) <= 2000
    assert rows_scanned(1 << 40) == (0, 0)


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "none"), LIBRARY, end_id=2)
    assert token_files.token_digests(token_files.read_token_files(spark, str(tmp_path / "none"))).count() == 0
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing_places_each_id_once(spark, library):
    texts = [*odd_texts(150), "many words stand here " * 900, *["some more text " * k for k in range(1, 90)]]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(1000, None, 1, None), (None, "no id", 2, "y")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(3), LIBRARY).collect()
    whole, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id][r.start] = r
        sequences[r.sequence_id].append(r)
    for doc_id, text, _, _ in rows:
        pieces = [whole[doc_id][s] for s in sorted(whole[doc_id])]
        ids = list(itertools.chain.from_iterable(p.ids for p in pieces))
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(p.doc_tokens == len(ids) for p in pieces)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == pieces[0].context_size <= 1024 and at & (at - 1) == 0


def test_packing_balances_steps():
    sequences = [(1024, [packing.Piece(packing.Document(0, b""), 0, n), packing.Piece(packing.Document(0, b""), 0, 1024 - n)]) for n in range(512, 1024, 4)]
    steps = packing.step_groups(sequences, 16 * 1024)
    cost = defaultdict(int)
    for (_, pieces), step in zip(sequences, steps, strict=True):
        cost[step] += sum(p.length**2 for p in pieces)
    assert len(cost) == 8 and max(cost.values()) < 1.02 * min(cost.values())
    assert packing.step_groups([], 1024) == []


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), LIBRARY).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(1, "a", 0, "")], DOCS), LIBRARY).agg(F.sum("length")).first()[0] == 2
