import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from foliospark.llm import mixing, secrets, tokens, toxicity


def stages(spark, folder, docs, labels):
    """What each stage leaves, written and read again as the pipeline does."""
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    current, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, folder)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{folder}/{name.replace(' ', '_')}"
        out.write.mode("overwrite").parquet(path)
        current = spark.read.parquet(path)
        kept[name] = current
    return kept


def rows_of(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic ones, near and exact copies, secrets, ids that repeat with other texts, null ids and texts, clashing columns."""
    rnd = random.Random(21)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    bases = [rnd.choices(words, k=rnd.choice([8, 40, 120])) for _ in range(60)]
    for i in range(400):
        text = list(rnd.choice(bases)) if i % 3 else rnd.choices(words, k=60)
        if i % 4 == 0 and len(text) > 50:
            text[rnd.randrange(len(text))] = "changed"
        if i % 8 == 0:
            text[2:2] = [rnd.choice(["snarkish", "blurgh"]) for _ in range(3)]
        if i % 11 == 0:
            text.append("token=" + "".join(rnd.choices("abcdef0123456789", k=32)))
        rows.append((i if i % 25 else 7, " ".join(text), "en", f"src{i % 3}", 0, "clash", 1.5))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(None, None, None, None, None, None, None), (None, "only here", "en", "src0", 9, "x", None), (500, "", "en", "src1", 0, "x", None), (501, "   ", "en", None, 3, "x", None)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark string, score double"
    return spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stages_against_brute_force(spark, tmp_path, corpus):
    docs, labels = corpus
    kept = stages(spark, str(tmp_path), docs, labels)
    everything = [r.asDict() for r in docs.collect()]
    # toxicity
    model = toxicity.fit(docs, labels)
    clean = [r for r in everything if toxicity.scores_of([r["text"] or ""], model, toxicity.scorer_of(model))[0] < 0.5]
    assert rows_of(kept["toxicity"]) == Counter(tuple(sorted(r.items())) for r in clean) and 300 < len(clean) < 380
    # near duplicates
    sets = []
    for r in clean:
        w = (r["text"] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(clean)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(clean)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups: dict = {}
    for i, r in enumerate(clean):
        groups.setdefault(find(i), []).append(r)
    got = [r.asDict() for r in kept["near duplicates"].collect()]
    assert len(got) == sum(1 if sets[i] else len(g) for i, g in groups.items())
    left = Counter(str(r["text"]) for r in got)
    for i, group in groups.items():
        if sets[i]:
            ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
            inside = [r for r in group if left[str(r["text"])] and (r["doc_id"] == min(ids) if ids else True)]
            assert inside
    # secrets
    encode = tokens.encoder(tokens.vocabulary())

    def masked(text):
        out = text
        for _, a, b in sorted(secrets.spans(text, encode, ratio=2.1, known=frozenset()), key=lambda x: -x[1]):
            out = out[:a] + "[SECRET]" + out[b:]
        return out

    want = Counter((r["doc_id"], masked(r["text"]) if r["text"] else r["text"]) for r in got)
    assert Counter((r["doc_id"], r["text"]) for r in kept["secrets"].collect()) == want and any("[SECRET]" in str(t) for _, t in want)
    # mixing: each row as often as its words are taken
    taken = Counter()
    for r in mixing.mix(kept["secrets"]).collect():
        taken[r["doc_id"], r["size"]] += int(np.floor(r["taken"] / r["size"] + 0.5)) if r["size"] else 0
    mixed = kept["mixing"].collect()
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed) == +taken
    # packing: the ids of all rows, once each
    total = sum(len(encode(r["text"] or "")) + 1 for r in mixed)
    pieces = kept["packing"].collect()
    assert sum(r["length"] for r in pieces) == total and max(r["offset"] + r["length"] for r in pieces) <= 1024


def test_stages_on_a_small_table(spark, tmp_path, docs):
    labels = spark.createDataFrame([(i, 1, int(i == 5)) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    kept = stages(spark, str(tmp_path), docs.repartition(1), labels)
    deduplicated = [r["doc_id"] for r in kept["near duplicates"].collect()]
    assert 1 in deduplicated and 2 not in deduplicated and deduplicated.count(6) == 1
    assert kept["secrets"].where("text like '%AKIA%'").count() == 0
    encode = tokens.encoder(tokens.vocabulary())
    mixed = {(r["doc_id"], r["text"]) for r in kept["mixing"].collect()}
    totals = {zlib.crc32(repr(m[0]).encode()): len(encode(m[1] or "")) + 1 for m in mixed}
    assert {r["doc_tokens"] for r in kept["packing"].collect()} == set(totals.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["packing"].count()


def test_an_empty_table_goes_through(spark, tmp_path, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = stages(spark, str(tmp_path), empty, labels)
    assert all(x.count() == 0 for x in kept.values())
