"""Toxicity, quality and secret scans."""

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_help import DATA, auc
from pyspark.sql import functions as F

from sievemark.llm import quality, secrets, toxicity
from sievemark.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def larger():
    return DATA.replace("sf0.001", "sf0.01")


def test_toxicity_held_out(spark, larger):
    lab = spark.read.parquet(f"{larger}/labels.parquet")
    p = QUERIES["op5_toxicity"](spark, larger).join(lab, "doc_id").where("held_out").toPandas()
    assert auc(p.toxic, p.score) > 0.8
    said = p[p.predicted == 1]
    assert len(said) == 0 or said.toxic.mean() > 0.8


def test_toxicity_grammar():
    g = toxicity.Grammar()
    kind = lambda t: {k: n for k, n in zip(toxicity.KINDS, g.counts(t)) if n}
    assert kind("What a stupid idea.") == {"insult": 1}
    assert kind("You are an idiot. Really.") == {"aimed": 1}
    assert kind("I will kill you.") == {"threat": 1}
    assert kind("They never kill you.") == {"negated": 1}
    assert kind("You are not an idiot.") == {"negated": 1}
    assert kind("The report said that idiot was the word.") == {"reported": 1}
    assert kind("A perfectly fine text.") == {}
    assert kind("kill the process") == {} and kind("") == {} and kind(None) == {}
    assert kind("idiot. idiot. idiot. idiot. idiot. idiot.")["insult"] == 6
    far = " ".join(f"word{i}" for i in range(400))
    assert kind(f"she said {far} you are an idiot") == {"reported": 1} and kind(f"{far} you are an idiot {far}") == {"aimed": 1}


def plain_counts(text, lexicon):
    """The grammar word by word, as the docstring has it: no automata and no composition."""
    out = dict.fromkeys(toxicity.KINDS, 0)
    weight = dict(zip(toxicity.KINDS, toxicity.PRIOR))
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause)

        def kind_of(w):
            if w in toxicity.THREATS:
                return "h"
            if w in toxicity.INSULTS or w in lexicon["words"]:
                return "i"
            for names, k in ((toxicity.REPORTS, "r"), (toxicity.NEGATIONS, "n"), (toxicity.TARGETS, "t"), (lexicon["weak_words"], "w")):
                if w in names:
                    return k
            return "i" if any(w.startswith(s) for s in lexicon["stems"]) else "w" if any(w.startswith(s) for s in lexicon["weak_stems"]) else "-"

        kinds = [kind_of(w) for w in words]
        near = lambda k, at: any(kinds[j] == k for j in range(max(0, at - 3), at))
        plain = lambda at: not near("n", at) and "r" not in kinds[:at]
        found = []
        for at, k in enumerate(kinds):
            if k in "ihw" and not plain(at):
                found.append("negated" if near("n", at) else "reported")
            elif k == "w":
                found.append("hint")
            elif k == "i":
                found.append("aimed" if near("t", at) else "insult")
            elif k == "h" and near("t", at):
                found.append("threat")
            elif k == "t":
                before = [kinds[j] for j in range(max(0, at - 3), at) if plain(j)]
                found += ["threat"] * ("h" in before) + ["aimed"] * ("i" in before)
        if found:
            out[max(found, key=weight.get)] += 1
    return list(out.values())


def test_toxicity_query_by_hand(spark, larger):
    """op5_toxicity's whole result from a plain reading of the grammar with the same model."""
    from sievemark.llm.common import documents

    model = toxicity.fit(documents(spark, larger), spark.read.parquet(f"{larger}/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, larger).collect()}
    lexicon = {k: set(v) for k, v in model["lexicon"].items()}
    for r in documents(spark, larger).select("doc_id", "text").collect():
        counts = plain_counts(r.text, lexicon)
        p = 1 / (1 + math.exp(-(model["base"] + sum(w * math.log2(1 + n) for w, n in zip(model["weights"], counts)))))
        g = got[r.doc_id]
        assert list(g.matches) == counts and abs(g.score - p) < 1e-9 and g.predicted == (g.score >= 0.7) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_transducers_compose():
    """Words through one machine after the other give what they give through the composed one."""
    first, second = toxicity.scope(), toxicity.aim()
    both = toxicity.compose(first, second, toxicity.CLASSES)
    rng = random.Random(4)
    for _ in range(300):
        a, b, ab = first.start, second.start, both.start
        for c in rng.choices(toxicity.CLASSES, k=12):
            a, between, _ = first.arcs[a, c]
            b, out, w = second.arcs[b, between]
            ab, one, heavy = both.arcs[ab, c]
            assert (one, heavy) == (out, w)


def test_toxicity_weights_order():
    base, w = toxicity.fit_weights([])
    p = lambda **k: 1 / (1 + np.exp(-(base + sum(dict(zip(toxicity.KINDS, w))[x] * np.log2(1 + n) for x, n in k.items()))))
    assert p(aimed=1) > p(insult=1) > p(reported=1) > p(negated=1) > p()


def test_toxicity_odd(spark, odd, none):
    lab = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(odd, lab)
    got = toxicity.score(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(none, m).count() == 0 and toxicity.reject(odd, m).columns == odd.columns
    empty = toxicity.fit(none, lab.limit(0))
    assert toxicity.score(odd, empty).count() == odd.count()


def test_toxicity_never_reads_the_held_out_fold(spark):
    """Labels of the fold whose crc32 remainder is 1 change nothing."""
    from llm_help import fold

    docs = spark.createDataFrame([(i, f"zorblax{i % 7} is a word {i}" if i % 2 else f"plain words {i}") for i in range(200)], "doc_id long, text string")
    lab = [(i, 1, i % 2) for i in range(200)]
    flipped = [(i, q, 1 - t if fold(i) == 1 else t) for i, q, t in lab]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (lab, flipped)]
    assert models[0] == models[1]


def test_quality_held_out(spark, larger):
    lab = spark.read.parquet(f"{larger}/labels.parquet")
    p = QUERIES["op10_quality"](spark, larger).join(lab, "doc_id").where("held_out").toPandas()
    assert auc(p.quality, p.tail_probability) > 0.9
    good = p[p.quality == 1]
    assert good.kept.mean() > 0.95


def test_quality_query_by_hand(spark, larger):
    """op10_quality's whole result from plain sums with the same model."""
    from sievemark.llm.common import documents

    docs = documents(spark, larger)
    model = quality.fit(docs, spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", F.col("quality").alias("grade")), grades=2)
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, larger).collect()}
    weight = lambda name: float(model["weights"][zlib.crc32(name.encode()) % quality.DIMENSIONS])
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        words = re.findall(r"[^\W_]+", text.lower())
        kinds, lines, n = set(words), [x for x in text.split("\n") if x.strip()], max(1, len(words))
        letters, chars = sum(map(len, words)), max(1, len(text))
        counted = lambda marks: sum(c in marks for c in text)
        stats = {
            "words": int(math.log2(len(words) + 1)), "distinct": int(20 * len(kinds) / n), "top": int(20 * max(Counter(words).values(), default=0) / n),
            "lines": int(20 * len(set(lines)) / max(1, len(lines))), "letters": int(20 * letters / chars), "upper": int(20 * sum(unicodedata.category(c) == "Lu" for c in text) / max(1, letters)),
            "digits": int(20 * counted("0123456789") / chars), "marks": int(20 * counted("!#$%&*@^~|<>{}[]=+\\/_") / chars), "stops": int(40 * counted(".?!") / n),
            "size": int(letters / n), "repeat": int(20 * sum(a == b for a, b in zip(words, words[1:])) / n),
        }
        s = sum(weight(f"s:{k}={v}") for k, v in stats.items()) + sum(weight("w:" + w) for w in kinds) / math.sqrt(max(1, len(kinds)))
        tail = 1 - 1 / (1 + math.exp(-(float(model["thresholds"][0]) - s)))
        g = got[r.doc_id]
        assert abs(g.tail_probability - tail) < 1e-4 and abs(g.expected_grade - tail) < 1e-4 and (g.kept == (tail >= 0.5) or abs(tail - 0.5) < 1e-4)


def test_quality_counts_capitals_alike_at_every_length():
    f = quality.Features()
    for n in (10, 5000):
        at, _ = f("ǅ" * n)  # title case is neither upper nor lower
        assert f.index("s:upper=0") in at


def test_ordinal_regression_on_four_grades():
    rng = np.random.default_rng(2)
    true = rng.normal(size=40)
    x = [(rng.choice(40, 12, replace=False).astype(np.int32), np.ones(12, np.float32)) for _ in range(1500)]
    latent = np.array([true[a].sum() for a, _ in x]) + rng.logistic(size=1500)
    grade = np.digitize(latent, [-2.5, 0.0, 2.5])
    w, theta = quality.fit_ordinal([a for a, _ in x[:1000]], [v for _, v in x[:1000]], grade[:1000], 4, 40)
    assert (np.diff(theta) > 0).all()
    s = np.array([w[a].sum() for a, _ in x[1000:]])
    expected = (1 / (1 + np.exp(theta[None, :] - s[:, None]))).sum(axis=1)
    assert np.corrcoef(expected, grade[1000:])[0, 1] > 0.75
    tail = 1 / (1 + np.exp(theta[1] - s))
    assert abs(tail.mean() - (grade[1000:] >= 2).mean()) < 0.06


def test_quality_odd(spark, odd, none):
    r = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None)], "doc_id long, grade int")
    m = quality.fit(odd, r, 2)
    assert quality.score(odd, m).count() == odd.count() and quality.score(none, m).count() == 0
    blank = quality.fit(none, r.limit(0), 3)
    assert quality.score(odd, blank, cut=2).where("kept").count() == odd.count()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out)


def secret_texts():
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    return [
        "password = hunter2x and Token: 'abcdef' api_key=\"short\" APIKEY: abcdef123", "AKIA" + "A1" * 8 + " AKIA123", "x" + "0f" * 12 + "g " + "ab" * 11,
        f"plain {key} words", "commit " + "a1" * 20, "id 123e4567-e89b-12d3-a456-426614174000 snake_case_identifier_of_many_words_2024", "secret=" + "f" * 30, "", None, "pass🎉word token:🎉 secret: zzzzzz🎉",
        "passpassword=aaaaaa password=password=bbbbbb token==cccccc",
    ]


def test_secrets(spark):
    import public_tokenizers

    texts = secret_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(d, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(b[1] == k for b in base) for k in range(3)], t
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert got[3].spans == "token:6:46"
    assert "token" not in got[5].spans and "token" not in got[4].spans
    clean = secrets.redact(d, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert clean[3].text == "plain [SECRET] words" and clean[8].text is None


def test_secrets_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op7_secrets"](spark, DATA).collect()}
    for r in rows:
        base = plain_base(r.text or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def plain_spans(text, encoding):
    """All spans, run by run."""
    base = plain_base(text)
    inside = bytearray(len(text))
    for s, _, e in base:
        inside[s:e] = b"\1" * (e - s)
    out = list(base)
    sparse = lambda x: len(x) / len(encoding.encode_ordinary(x)) < 1.85
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        for k in re.finditer(b"\0+", bytes(inside[m.start() : m.end()])):
            s, e = m.start() + k.start(), m.start() + k.end()
            run = text[s:e]
            if e - s < 20 or (len(run) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-f]+", run)) or (len(run) in (32, 40, 64) and re.fullmatch("[0-9A-F]+", run)):
                continue
            if re.fullmatch("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", run):
                continue
            parts = [p for p in re.split("[_/=+-]", run) if p]
            names = all(p.islower() and p.isalpha() or p.isupper() and p.isalpha() or p[1:].islower() and p.isalpha() or len(p) == 1 and p.isalpha() or p.isdigit() and len(p) <= 8 for p in parts)
            if any(len(p) >= 20 and sparse(p) for p in parts) if names else sparse(run):
                out.append((s, 3, e))
    return sorted(out)


def test_secret_spans_by_hand(spark):
    import public_tokenizers

    rng = random.Random(6)
    some = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f"key {some(low, 40)} and {some(up + low, 32)} and {some(up + low + '0123456789+/', 48)}==" for _ in range(30)]
    texts += [some(up + low + "0123456789", 30) + "-" + "0a" * 14 + some(up, 24) for _ in range(10)] + ["Donaudampfschifffahrtsgesellschaft and internationalization_of_things"]
    texts += [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test = secrets.TokenTest(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r.spans for r in secrets.scan(d, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t, test.encoding)), t
    assert all(got[i].count("token") >= 2 for i in range(30)) and sum(got[i].count("token") == 3 for i in range(30)) >= 25 and got[40] == ""


def test_secrets_take_time_by_length():
    import public_tokenizers

    test = secrets.TokenTest(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for t in ("-" * 16 + "ab12cd", "title\n" + "-" * 30 + "ab12cd end", "-" * 1_000_000, "=a" * 100_000, "token=abcdef " * 50_000, "a_1" * 100_000):
        start = time.time()
        secrets.spans(t, test)
        assert time.time() - start < 10


def test_secrets_odd(odd, none):
    import public_tokenizers

    scan = lambda d: secrets.scan(d, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert scan(odd).count() == odd.count() and scan(none).count() == 0


def test_folds(spark):
    from llm_help import fold

    from sievemark.llm.common import crc_fold

    got = spark.range(50).select("id", crc_fold(F.col("id")).alias("f")).collect()
    assert all(r.f == fold(r.id) for r in got)
