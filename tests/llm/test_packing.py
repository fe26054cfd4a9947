import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from foliospark.llm import packing, tokens


def ids_of(texts):
    tokenizer = Tokenizer.from_file(tokens.vocabulary())
    return [np.array([*e.ids, 0], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, want):
    """Pieces cover every id once; sequences are gapless and powers of two up to 1024."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, ids in want.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0 and len({(r["tier"], r["step_group"]) for r in pieces}) == 1


def test_pack(spark, docs, empty):
    assert packing.pack(empty).count() == 0
    rows = [r for r in docs.select("doc_id", "text").collect() if r[0] is not None and r[0] != 6]
    kept = docs.where("doc_id <> 6")
    want = dict(zip([r[0] for r in rows], ids_of([r[1] for r in rows])))
    check([r.asDict() for r in packing.pack(kept).collect()], want)
    assert packing.pack(docs.where("doc_id = 6")).count() == 2


def test_rounds_and_windows():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices("alpha beta gamma delta word <|endoftext|> 12".split(), k=rnd.choice([0, 3, 40, 300, 2500]))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(list(packing.packed([batch], path=tokens.vocabulary(), sizes=(128, 256, 512, 1024), separator=0, round_tokens=5000, step_tokens=4096, first_sequence=5 << 33)))
    rows = out.to_pylist()
    check(rows, dict(enumerate(ids_of(texts))))
    groups = {}
    for s in {r["sequence_id"]: r for r in rows}.values():
        groups.setdefault((s["tier"], s["step_group"]), []).append(s["tier"])
    assert len({g for _, g in groups}) == len(groups)
    for tier in (512, 1024):
        sizes = [sum(v) for (t, g), v in sorted(groups.items()) if t == tier]
        assert all(x == 4096 for x in sizes[:-1])
    assert sum(r["length"] for r in rows if r["tier"] >= 128) >= 0.99 * sum(r["length"] for r in rows)
