"""The toxicity model: held-out accuracy, located sentences and odd inputs."""

import math
import random
import zlib

import pytest

from riskloom.llm import toxicity
from tests.llm.cases import no_documents, odd_documents, pairs, rows

FOLDER = "/root/testdata/sf0.1"


def made_up(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        toxic = i % 5 == 0
        parts = [" ".join(draw.choice(words) for _ in range(8)) for _ in range(draw.randint(1, 12))]
        if toxic:
            parts[draw.randrange(len(parts))] += " " + draw.choice(["grumpfool", "grumpfest", "slimehead"])
        out.append((". ".join(parts) + ".", int(toxic)))
    return out


def test_learns_from_document_labels_and_finds_the_sentence():
    model = toxicity.fit([(t.encode(), y) for t, y in made_up(600, 1)])
    wrong = 0
    for text, label in made_up(400, 2):
        score, located = toxicity.score_text(text.encode(), model)
        assert 0 <= score <= 1
        wrong += (score >= 0.3) != bool(label)
        for s in located:
            assert any(x in text[s["start"] : s["end"]] for x in ("grump", "slime"))
    assert wrong <= 8


def test_fit_without_both_labels():
    for sample in ([], [(b"a b.", 1)], [(b"a b.", 0), (b"c", 0)]):
        assert toxicity.score_text(b"a b. c", toxicity.fit(sample)) == (0.0, [])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    report = toxicity.toxicity_report(toxicity.score(docs, toxicity.train(docs, labels)))
    found = {r["doc_id"]: r for r in report.collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for d, r in found.items())
    known = [(found[r["doc_id"]], r["toxic"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    toxic = [r["predicted"] for r, y in known if y]
    clean = [r["predicted"] for r, y in known if not y]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.01/" + t + ".parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_odd_inputs(spark):
    model = toxicity.Model({b"hate ": 5.0}, -1.0)
    docs = odd_documents(spark, ["I hate you. Fine.", "HATE", "hated"])
    got = dict(rows(toxicity.score(docs, model), "doc_id", "score"))
    assert got[100] > 0.9 and got[101] > 0.9 and got[102] == 0 and got[3] == 0 and got[4] == 0
    kept = toxicity.keep_civil(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert toxicity.score(no_documents(spark), model).count() == 0
    odd_labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (2, None, "x"), (2, 7, "x"), (100, 1, "x")], "doc_id long, toxic int, text string")
    assert toxicity.train(docs, odd_labels).weights == {}
    assert toxicity.train(no_documents(spark), odd_labels).weights == {}
    assert toxicity.train(docs, odd_labels.limit(0)).weights == {}


@pytest.mark.parametrize("sample_docs, sample_bytes", [(5, 10**9), (10**6, 20_000)])
def test_sample_is_bounded(spark, monkeypatch, sample_docs, sample_bytes):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.01/" + t + ".parquet") for t in ("documents", "labels"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.extend(sample) or toxicity.Model({}, 0.0))
    toxicity.train(docs, labels, sample_docs=sample_docs, sample_bytes=sample_bytes)
    assert 0 < len(seen) <= sample_docs and sum(len(t) for t, _ in seen) <= sample_bytes


def test_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(d, f"text {d} {k} " + "x" * 100) for d in range(20) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(20)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.extend(sample) or toxicity.Model({}, 0.0))
    toxicity.train(docs, labels, sample_bytes=5_000)
    assert 0 < len(seen) == len({t.split()[1] for t, _ in seen}) and sum(len(t) for t, _ in seen) <= 5_000


# plain twins of scoring and of the gradient


def plain_sentences(text):
    """(start, end, words) in bytes, one character at a time."""
    out, start, raw = [], 0, text.encode("utf-8", "surrogatepass")
    for i, c in enumerate(raw + b"\n"):
        if i == len(raw) or chr(c) in {chr(x) for x in range(128) if toxicity.SENTENCE_TABLE[x] == 0x0A}:
            words, word = [], b""
            for b in raw[start:i] + b" ":
                if b >= 128 or chr(b).isalnum():
                    word += bytes([b]).lower()
                elif word:
                    words.append(word)
                    word = b""
            out.append((start, i, words))
            start = i + 1
    return out


def plain_features(words):
    return {w + b" " for w in words} | {w[:n] for w in words for n in (4, 5, 6, 7, 8) if len(w) >= n}


def plain_score(text, weights, bias):
    """1 less the product over sentences with a weighted feature of the chance to be clean."""
    clean, located = 1.0, []
    for number, (start, end, words) in enumerate(plain_sentences(text or "")):
        found = [weights[f] for f in plain_features(words) if f in weights]
        if found:
            p = 1 / (1 + math.exp(-(bias + sum(found))))
            clean *= 1 - p
            if p >= toxicity.OFFENDING:
                located.append((number, start, end))
    return 1 - clean, located


def test_scores_equal_a_plain_loop(spark):
    weights = {b"fool ": 3.0, b"idio": 2.5, b"rubbish": 1.5, "idiôt".encode()[:5]: 0.7, b"the ": -0.4, b"word": -1.0, b"9999": 4.0}
    texts = ["You FOOL! The idiots\nare rubbishy. Idiotic fool?", "the the the", "fool" * 50 + ". fool", "idiôté fool\x00idio", "9999 fool. 99999! no", "...\n\n!?"]
    docs = odd_documents(spark, texts)
    model = toxicity.Model(weights, -1.0)
    got = toxicity.score(docs, model).collect()
    want = sorted(((d, plain_score(t, weights, -1.0)) for d, t in pairs(docs)), key=repr)
    have = sorted(((r["doc_id"], (r["score"], [(o["sentence"], o["start"], o["end"]) for o in r["offending"]])) for r in got), key=repr)
    for (d, (s, places)), (e, (z, spots)) in zip(sorted(want, key=lambda x: repr(x[0])), sorted(have, key=lambda x: repr(x[0]))):
        assert d == e and z == pytest.approx(s, abs=1e-12) and spots == places
    assert any(places for _, (_, places) in want)


def test_the_first_step_follows_the_gradient():
    """The optimiser's first step is ``rate`` against the sign of each slope, here of finite differences of a plain loss."""
    rows = [(b"bad fool here. nice day", 1), (b"fool again", 1), (b"nice day. good word", 0), (b"good fool. nice", 0), (b"bad words", 1), (b"day word", 0)]
    model = toxicity.fit(rows, least_docs=1, lift=0.0, steps=1, rate=0.1)
    names = sorted(toxicity.screened(rows, 1, 0.0))

    def loss(weights, bias):
        total = 0.0
        for text, y in rows:
            score, _ = plain_score(text.decode(), weights, bias)
            total -= math.log(max(score if y else 1 - score, 1e-12))
        return total / len(rows)

    zero, e = dict.fromkeys(names, 0.0), 1e-5
    assert set(model.weights) <= set(names) and len(model.weights) > 10
    for f in names:
        slope = (loss({**zero, f: e}, -2.0) - loss({**zero, f: -e}, -2.0)) / (2 * e)
        if abs(slope) > 1e-7:
            assert model.weights[f] == pytest.approx(-0.1 * math.copysign(1, slope), rel=1e-3)
    slope = (loss(zero, -2.0 + e) - loss(zero, -2.0 - e)) / (2 * e)
    assert model.bias == pytest.approx(-2.0 - 0.1 * math.copysign(1, slope), rel=1e-3)
