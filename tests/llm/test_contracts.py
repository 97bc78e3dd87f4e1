"""Every registered query of the subpackage: columns, types and what its contract fixes, on whole small tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from graphloom.llm import queries
from graphloom.llm.edit_fingerprint import edited_text

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": "doc_id bigint, class_id bigint, n_links bigint",
    "op2": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def results(spark):
    """The rows of each query, run once."""
    kept = {}

    def rows(number):
        name = next(q for q in queries.QUERIES if q.startswith(number + "_"))
        if name not in kept:
            frame = queries.QUERIES[name](spark, SF)
            kept[name] = frame.dtypes, frame.collect()
        return kept[name]

    return rows


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("number", COLUMNS)
def test_columns_and_types(results, texts, number):
    types, rows = results(number)
    assert set(tuple(c.split(" ")) for c in COLUMNS[number].split(", ")) <= set(types)
    if number not in ("op3", "op7", "op10"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)


def test_toxicity_contract(results):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    for r in results("op2")[1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in results("op2")[1] if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.8


def test_chat_contract(results):
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list, {-1: [("user", said), ("assistant", said)]})
    for conv, role, text in duckdb.sql(f"SELECT conv_id, role, coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        turns[conv].append((role, text))
    rows = {r.conv_id: r for r in results("op3")[1]}
    assert set(rows) == set(turns)
    for k, r in rows.items():
        loss = "".join(t for role, t in turns[k] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns[k]), len(loss), sha(loss))
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in turns[k]))
        assert r.formatted_chars >= sum(len(t) for _, t in turns[k])


def test_byte_bpe_contract(results, texts):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = regex.compile(public_tokenizers.PATTERN)
    for r in results("op4")[1]:
        ids = codec.encode_ordinary(texts[r.doc_id])
        whole = "".join(m.group() for m in split.finditer(texts[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(whole))


def test_fingerprint_contract(results, texts):
    rows, order = {r.doc_id: r for r in results("op5")[1]}, sorted(texts, reverse=True)
    seen = {}
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        r = rows[k]
        assert r.n_chars == len(texts[k]) and r.edited_sha256 == sha(edited_text(texts[k], texts[after]))
        assert seen.setdefault(texts[k], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_token_file_contract(results, texts):
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in sorted(results("op6")[1], key=lambda r: r.doc_id):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_embedding_contract(results):
    rows = {r.vec_id: r for r in results("op7")[1]}
    vectors = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([v for _, v, _ in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([label for _, _, label in vectors])
    linked = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    assert len(rows) == len(vectors)
    assert sum(r.n_links for r in rows.values()) >= 0.99 * linked.sum()
    for (k, _, _), row in zip(vectors, linked, strict=True):
        assert rows[k].n_links <= row.sum() and rows[k].kept == (rows[k].component_id == k)


def test_shard_contract(results, texts):
    slots = defaultdict(list)
    for r in results("op9")[1]:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing_contract(results, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in results("op10")[1]:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for k, mine in pieces.items():
        ids, at = [*library.encode(texts[k], add_special_tokens=False).ids, 0], 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length]) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    padding = 0
    for mine in sequences.values():
        ends = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.length
        assert ends <= 1024
        padding += 0 if ends & (ends - 1) == 0 else 1024 - ends
    assert padding == 0


def test_fingerprint_groups(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["fingerprint_groups"](spark, SF).collect()}
    assert set(rows) == set(texts)
    copies = defaultdict(set)
    for k, t in texts.items():
        copies[t].add(rows[k].component_id)
    assert all(len(c) == 1 for c in copies.values())
