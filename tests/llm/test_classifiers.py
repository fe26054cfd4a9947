import random

import numpy as np
import pytest

from foliospark.llm import quality, toxicity
from foliospark.llm.labelled import labelled_sample


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(4)
    plain = "the quick brown fox jumps over a lazy dog while many people read books in quiet rooms".split()
    rows, labels = [], []
    for i in range(600):
        words = rnd.choices(plain, k=rnd.randrange(20, 80))
        bad, junk = i % 6 == 0, i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["snarkish", "snarkling", "blurgh"]))
        if junk:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * 60
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 17 == 0 else int(not junk), int(bad)))
    rows += [(1000, None), (1001, ""), (None, "fox"), (1, "the dog")]
    labels += [(5000, 1, 1), (None, 1, 1), (2, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_accuracy(labelled, operator, label):
    docs, labels = labelled
    scored = operator(docs, labels)
    rows = scored.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r[label] for r in labels.where("doc_id < 600 and doc_id > 2").collect()}
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    right = [r["predicted"] == truth[r["doc_id"]] for r in held]
    assert len(held) > 60 and np.mean(right) > 0.95


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_without_labels_or_rows(labelled, operator):
    docs, labels = labelled
    assert {r["score"] for r in operator(docs, labels.where("1 = 0")).collect()} == {0.0}
    assert operator(docs.where("1 = 0"), labels).count() == 0


def test_clean_documents_keep_columns(labelled):
    docs, labels = labelled
    out = toxicity.clean_documents(docs, labels)
    assert out.columns == docs.columns
    assert out.where("doc_id = 1001 or doc_id = 1000").count() == 2


def read(*symbols):
    following, outputs = toxicity.grammar()
    state, out = 0, []
    for s in symbols:
        code = toxicity.BASE.index(s)
        out.append(outputs[state][code])
        state = following[state][code]
    return out


def test_grammar_marks():
    assert read("target", "other", "insult") == ["target", "other", "insult@"]
    assert read("negation", "target", "insult") == ["negation", "target", "insult-"]
    assert read("report", "other", "target", "insult") == ["report", "other", "target", 'insult"']
    assert read("insult", "other", "threat") == ["insult", "other", "held"]
    assert read("threat", "other", "target") == ["held", "other", "threat@"]
    assert read("target", "threat", "target") == ["target", "threat@", "target"]
    assert read("threat", "stop", "target") == ["held", "stop", "target"]
    assert read("negation", "threat", "target") == ["negation", "held", "threat-"]
    assert read("negation", *["other"] * 5, "insult")[-1] == "insult"
    assert read("report", "stop", "insult")[-1] == "insult"
    assert read("quote", "other", "stop", "insult", "quote", "insult") == ["quote", "other", "stop", 'insult"', "quote", "insult"]
    assert read("open", *["other"] * 30, "insult")[-1] == "insult"


def slow_read(symbols):
    """The three rules one after the other, each from the whole string so far."""
    def since(i, names, reach):
        for j in range(i - 1, max(-1, i - reach - 1), -1):
            if symbols[j] == "stop":
                return False
            if symbols[j] in names:
                return True
        return False

    out = []
    pending = None
    quoted, spoken = 0, 0  # symbols left
    for i, s in enumerate(symbols):
        o = s
        if s == "stop":
            pending = None
        elif s == "insult" and since(i, ("target",), 5):
            o = "insult@"
        elif s == "threat":
            o = "threat@" if since(i, ("target",), 5) else "held"
            pending = i if o == "held" else None
        elif s == "target" and pending is not None and i - pending <= 4:
            o, pending = "threat@", None
        if o in toxicity.KINDS:
            if since(i, ("negation",), 4):
                o = toxicity.marked(o, "-")
            if quoted or spoken:
                o = toxicity.marked(o, '"')
        out.append(o)
        if s == "close" or s == "quote" and quoted:
            quoted = spoken = 0
        elif s in ("open", "quote"):
            quoted, spoken = 24, 0
        elif quoted:
            quoted -= 1
        elif s == "stop":
            spoken = 0
        elif s == "report":
            spoken = 12
        else:
            spoken = max(0, spoken - 1)
    return out


def test_machine_against_the_rules():
    rnd = random.Random(5)
    for _ in range(2000):
        symbols = rnd.choices(toxicity.BASE, weights=[rnd.choice([1, 8]), *[1] * 9], k=rnd.randrange(40))
        assert read(*symbols) == slow_read(symbols), symbols


def slow_features(text, lexicon, words):
    """A text's features from the rules, without the machine or the cache of classes."""
    tokens, symbols, weights = toxicity.tokens_of(text), [], []
    for token in tokens:
        word = toxicity.bare(token)
        weight = max([lexicon.get(f, 0) for f in toxicity.features_of_word(word)] or [0]) if word else 0
        mark = "stop" if token == "\x00" else toxicity.MARKS_OF_TEXT.get(token)
        symbols.append(mark or ("insult" if weight else words.get(word, "other")))
        weights.append(weight or 1.0)
    out = slow_read(symbols)
    sums = [sum(w for o, w in zip(out, weights) if o == k) for k in toxicity.KINDS]
    clauses, live = [0.0], []
    for o, w, token in zip(out, weights, tokens):
        if o == "stop":
            clauses.append(0.0)
        elif o in toxicity.LIVE:
            clauses[-1] += w
            live.append((w, toxicity.bare(token)))
    total, n, log = sum(w for w, _ in live), np.log1p(len(tokens)), np.log1p
    different = log(len({t for _, t in live}))
    return [*log(sums), max(clauses), log(sum(c > 0 for c in clauses)), log(len(live)), different, log(total), log(total) * n, different * n, n]


def test_features_against_brute_force():
    rnd = random.Random(8)
    lexicon = {"=idiot": 3.0, "snark": 2.0}
    words = {w: k for k, given in toxicity.LEXICONS.items() for w in given}
    pool = ["idiot", "snarkish", "you", "kill", "not", "said", "fox", "dog.", "(idiot!)", "“fine", "enough”", "well:", '"so', 'then"', "line\n", "shut", "up!idiot", "ÜBER"]
    scorer = toxicity.Scorer(lexicon, words)
    for _ in range(500):
        text = " ".join(rnd.choices(pool, k=rnd.randrange(30)))
        want = slow_features(text, lexicon, words)
        got = scorer.features(text)
        # without insults and threats the machine isn't run
        assert np.allclose(got, want), text
    assert scorer.features("shut up!idiot")[0] > 0 and len(scorer.features("")) == toxicity.FEATURES


@pytest.fixture(scope="module")
def spoken(spark):
    """Insults in toxic and clean documents, and all other words in both: only what stands around an insult tells."""
    rnd = random.Random(9)
    plain = "the fox jumps over a dog while many people read you are what this is not she said that so and was printed zonk well".split()
    insults = ["snarkish", "blurgh", "grimbly"]
    kinds = [("you are {}", 1), ("what {} fox", 1), ("this is not {}", 0), ("she said: that is {}", 0), ("“so {} . and {}” was printed", 0), ("zonk {}", 0), *[("well", 0)] * 12]
    rows, labels = [], []
    for i in range(3600):
        form, toxic = kinds[i % len(kinds)]
        words = [" ".join(rnd.choices(plain, k=rnd.randrange(5, 30))) + "." for _ in range(2)]
        words.insert(1, form.format(rnd.choice(insults), rnd.choice(insults)) + ".")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, i % len(kinds) < 6))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int, hard boolean")


def held_out_accuracy(docs, labels, **options):
    rows = toxicity.toxicity(docs, labels, **options).where("held_out").join(labels, "doc_id").where("hard").collect()
    return np.mean([r["predicted"] == r["toxic"] for r in rows])


def test_the_grammar_decides(spoken):
    docs, labels = spoken
    assert held_out_accuracy(docs, labels) > 0.95
    assert held_out_accuracy(docs, labels, machine=toxicity.plain()) < 0.75
    assert toxicity.fit(docs, labels)["words"].get("zonk") == "negation"


def test_classifiers_take_clashing_columns_and_long_texts(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, int(i == 5)) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    for operator in (toxicity.toxicity, quality.quality):
        rows = operator(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        by_id = {}
        for r in rows:
            by_id.setdefault(r["doc_id"], set()).add(r["score"])
        assert by_id[1] == by_id[2] and len(by_id[6]) == 1 and by_id[3] == by_id[4]


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.range(2000).selectExpr("id % 4 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", modulus=5, held_out=99, most=100)
    assert sample.count() == 100 and sample.select("text").distinct().count() == 100


def test_discriminant_is_the_gaussian_one():
    rnd = np.random.default_rng(0)
    x = np.vstack([rnd.normal(0, 1, (300, 3)), rnd.normal(1, 2, (200, 3))])
    y = np.array([0] * 300 + [1] * 200)
    model = quality.train(x, y)
    z = (x - model["center"]) / model["scale"]
    logs = []
    for mean, inverse, _, prior in model["classes"]:
        cov = np.linalg.inv(inverse.T @ inverse)
        d = z - mean
        logs.append(prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(quality.difference(x, model), logs[1] - logs[0])
