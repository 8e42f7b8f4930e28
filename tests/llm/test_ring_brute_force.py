"""op10 against a plain walk around the ring, one key at a time."""

import bisect
import struct
import zlib

import pytest
import xxhash

pytest.importorskip("weirflow.llm")
from weirflow.llm import queries, sharding  # noqa: E402

ODD = [(None, None), (None, ""), (1, ""), (1, ""), (2, None), (3, "é " * 500), (4, "same"), (5, "same"), (6, "x" * 200_000), (-7, "\n\t ")]


def position(doc_id, text, seed=17):
    """Spark's xxhash64 of (doc_id, text, seed): each value is hashed with the hash before it as seed, nulls are passed over."""
    h = 42
    for part in (None if doc_id is None else struct.pack("<q", doc_id), (text or "").encode(), struct.pack("<i", seed)):
        if part is not None:
            h = xxhash.xxh64(part, seed=h).intdigest()
    return h & (sharding.RING - 1)


def walk(rows, shards=16, vnodes=64, seed=17):
    """{(doc_id, size, crc): sorted (shard, slot)}."""
    points = sharding.ring(shards, vnodes, seed)
    at = [p for p, _ in points]
    keys = []
    for doc_id, text in rows:
        raw, h = (text or "").encode(), position(doc_id, text)
        keys.append((bisect.bisect_left(at, h) % len(at), h, doc_id is not None, doc_id or 0, zlib.crc32(raw), len(raw) + 1, doc_id))
    keys.sort(key=lambda k: k[:6])
    room = [len(rows) // shards + (i < len(rows) % shards) for i in range(shards)]
    where, waiting = {}, []
    for n, k in enumerate(keys):
        owner = points[k[0]][1]
        if room[owner]:
            room[owner] -= 1
            where[n] = owner
        else:
            waiting.append(n)
    for n in waiting:
        j = keys[n][0]
        while not room[points[j][1]]:
            j = (j + 1) % len(points)
        room[points[j][1]] -= 1
        where[n] = points[j][1]
    slots, out = [0] * shards, {}
    for n, k in enumerate(keys):
        out.setdefault((k[6], k[5], k[4]), []).append((where[n], slots[where[n]]))
        slots[where[n]] += 1
    return {k: sorted(v) for k, v in out.items()}


def by_document(got):
    out = {}
    for r in got:
        out.setdefault((r.doc_id, r.size, r.text_crc32), []).append((r.shard, r.slot))
    return {k: sorted(v) for k, v in out.items()}


def test_query_walks_the_ring(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert by_document(queries.op10_sharding(spark, sf).collect()) == walk(rows)


@pytest.mark.parametrize("keep", [[], ["text"]])
@pytest.mark.parametrize("block_rows", [2, 50_000])
def test_blocks_change_nothing(spark, keep, block_rows):
    docs = spark.createDataFrame(ODD * 3, "doc_id long, text string")
    assert by_document(sharding.shard_rows(docs, block_rows=block_rows, keep=keep).collect()) == walk(ODD * 3)
