"""Quality, pieces, languages, secrets: held-out accuracy, round trips and edge rows."""

from __future__ import annotations

import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rankloom.llm import langid, quality, secrets, spm_fst
from rankloom.llm.registry import GRADE, TOKENIZERS, TOP

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
EDGES = [(1, None), (2, ""), (3, " \n"), (None, "words here"), (4, "same text"), (4, "same text"), (5, "long " * 60_000)]
SF = "/root/testdata/sf0.1"


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- quality ----


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 900)
    data = [np.unique(np.r_[rng.integers(100, 400, 20), [7] if g == 0 else [], [9] if g == 2 and i % 9 else []]).astype(np.int64) for i, g in enumerate(grades)]
    m = quality.fit(data, grades, 2)
    assert m.theta[0] < m.theta[1] and m.weights[7] < -1 and m.weights[9] > 1
    t = m.tails(0.3)
    assert 1 > t[0] > t[1] > 0
    assert (np.abs(m.weights) > 0).sum() <= 40


def dense_slopes(x, grades, w, theta):
    """Value and slopes of the mean negative log likelihood, from P(grade <= j) = 1 / (1 + exp(w.x - theta_j)) itself."""
    below = 1 / (1 + np.exp(np.clip((x @ w)[:, None] - np.r_[-60.0, theta, 60.0][None], -60, 60)))
    below[:, 0], below[:, -1] = 0, 1
    n, value, gw, gt = len(grades), 0.0, np.zeros(len(w)), np.zeros(len(theta))
    for row, g, b in zip(x, grades, below):
        p = b[g + 1] - b[g]
        up, low = b[g + 1] * (1 - b[g + 1]) / p, b[g] * (1 - b[g]) / p
        value -= np.log(p) / n
        gw += (up - low) * row / n
        if g < len(theta):
            gt[g] -= up / n
        if g:
            gt[g - 1] += low / n
    return value, gw, gt


def test_fit_equals_a_dense_one():
    rng = np.random.default_rng(5)
    n, f = 240, 30
    x = (rng.random((n, f)) < rng.uniform(0.05, 0.6, f)).astype(float)
    true = np.zeros(f)
    true[[2, 5, 9]] = 2.0, -2.5, 1.5
    grades = np.digitize(x @ true + rng.logistic(size=n), [-0.7, 0.9])
    m = quality.fit([np.flatnonzero(r) for r in x], grades, 2, l2=0.01)
    picked = np.flatnonzero(m.weights)
    # the same choice by plain proximal steps over all features
    w, theta, l1 = np.zeros(f), np.array([-0.5, 0.5]), 8 / n
    for _ in range(3000):
        _, gw, gt = dense_slopes(x, grades, w, theta)
        w = w - 0.5 * gw
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * l1, 0)
        theta = theta - 0.5 * gt
    _, gw, _ = dense_slopes(x, grades, w, theta)
    sure = np.abs(np.abs(gw) - l1) > 0.03 * l1
    assert {2, 5, 9} <= set(picked) <= set(np.flatnonzero((w != 0) | ~sure)) and set(np.flatnonzero((np.abs(w) > 0.02))) <= set(picked)
    # and the same optimum with these alone
    _, gw, gt = dense_slopes(x[:, picked], grades, m.weights[picked].astype(float), m.theta)
    assert np.abs(gw + 0.01 * m.weights[picked]).max() < 1e-4 and np.abs(gt).max() < 1e-4


def test_rare_features_cannot_reach_the_penalty():
    rng = np.random.default_rng(6)
    grades = np.r_[np.zeros(60, int), np.full(60, 2)]
    data = [np.array([5] * int(g == 0) + [100 + i] * (i < 7) + [50 + int(rng.integers(3))]) for i, g in enumerate(grades)]
    m = quality.fit(data, grades, 2)
    assert m.weights[5] < 0 and not m.weights[100:107].any()


def test_selection_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), GRADE, TOP)
    assert np.count_nonzero(model.weights)
    import xxhash

    want = {}
    for i, text in docs.select("doc_id", "text").collect():
        words = re.findall(r"\w+", (text or "").lower())
        if not words:
            continue
        names = set(words) | {f"{w[:n]} *" for w in words for n in (3, 4, 5, 6, 7) if n < len(w)} | set(quality.style(text, words, len(set(words))))
        score = sum(float(model.weights[b]) for b in {xxhash.xxh64_intdigest(x.encode(), 7) % len(model.weights) for x in names})
        tails = [1 - 1 / (1 + math.exp(score - t)) for t in model.theta]
        if tails[TOP - 1] >= quality.CUTOFF:
            want[i] = (sum(tails), tails[TOP - 1])
    got = {r[0]: (r[1], r[2]) for r in quality.selected(docs, model, TOP).collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-4 for i in got for a, b in zip(got[i], want[i]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"), GRADE, TOP)
    held = labels.where("doc_id % 4 = 0").withColumn("good", F.expr(GRADE) == TOP)
    kept = quality.selected(docs, model, TOP).select("doc_id", F.lit(True).alias("kept"))
    got = held.join(kept, "doc_id", "left").select("good", F.coalesce("kept", F.lit(False)), "toxic").collect()
    clean = [r for r in got if r[0]]
    toxic = [r for r in got if r[2]]
    assert np.mean([r[1] for r in clean]) > 0.98
    assert np.mean([not r[1] for r in toxic]) > 0.93
    assert np.mean([r[0] == r[1] for r in got]) > 0.97


def test_quality_edges(spark, make):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (0, 1, 0), (1, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make([(i, "good fine text" if i % 2 else "bad awful junk") for i in range(60)])
    model = quality.train(docs, labels, GRADE, TOP)
    edge = make([*EDGES, (90, "good fine text"), (91, "bad awful junk")])
    kept = {r[0] for r in quality.selected(edge, model, TOP, 0.5).collect()}
    assert 90 in kept and 91 not in kept and not kept & {1, 2, 3}
    out = quality.kept_rows(edge, model, TOP, 0.5)
    assert out.columns == edge.columns and {r["doc_id"] for r in out.collect()} == kept
    assert quality.scored(edge, model, TOP).count() == edge.count()
    assert quality.train(make([]), labels, GRADE, TOP) is None and quality.train(docs, labels.where("false"), GRADE, TOP) is None
    assert quality.kept_rows(edge, None, TOP).count() == edge.count() == quality.selected(edge, None, TOP).count()
    assert quality.selected(make([]), model, TOP).count() == 0


# ---- pieces ----


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(spark, library):
    machine = spm_fst.transducer(PIECES)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    alphabet = "aeinorst  .,'\"\n\tAZé日本😀▁١²-_();=0123\x00"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "  two  spaces ", "x" * 3000, "_), __); e.g. it's", "ﬁ ½ İ", "a\r\n\r\nb", "​﻿"]
    for t, want in zip(texts, library.encode(texts)):
        got = machine.encode(t)
        assert got.tolist() == want, t
        assert machine.decode(got) == t.replace("▁", " ")


def test_piece_table_edges(make):
    df = spm_fst.encoded(make([*EDGES, (6, "a ▁ b")]), PIECES)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in df.collect()}
    assert got[1] == (None, None) and got[2] == ([], "") and got[3][1] == " \n" and got[5][1] == "long " * 60_000 and got[6][1] == "a   b"
    assert df.count() == len(EDGES) + 1 and None in got
    back = spm_fst.decoded(df.select("ids"), PIECES)
    assert sorted(map(str, (r[0] for r in df.select("decoded").collect()))) == sorted(map(str, (r["decoded"] for r in back.collect())))
    assert spm_fst.encoded(make([]), PIECES).count() == 0
    assert spm_fst.transducer(PIECES).decode([10**9, -1]) == "��"


def unigram_model() -> bytes:
    def field(n, kind, raw):
        return bytes([n << 3 | kind]) + (bytes([len(raw)]) + raw if kind == 2 else raw)

    def piece(text, score, kind):
        own = field(1, 2, text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        return field(1, 2, own)

    pieces = [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3.5, 1), ("▁a", -2.5, 1), ("ba", -1, 1)]
    return b"".join(piece(*p) for p in pieces) + field(2, 2, field(3, 0, bytes([1])))


def every_path(m, text):
    """(cost, pieces) of all paths of the composition, by trying each arc at each place."""
    out, todo = [], [(0, 0.0, [])]
    while todo:
        i, cost, pieces = todo.pop()
        if i == len(text):
            out.append((cost, pieces))
            continue
        for j in range(i + 1, len(text) + 1):
            p = text[i:j]
            if p not in m.weight and j > i + 1:
                continue
            if m.kind == spm_fst.BPE and not m._allowed(pieces[-1] if pieces else "", p):
                continue
            todo.append((j, cost + m.weight.get(p, m._worst), [*pieces, p]))
    return out


def test_least_cost_equals_enumeration():
    rng = random.Random(8)
    for m, signs in ((spm_fst.transducer(PIECES), "▁the andré日1x"), (spm_fst.Transducer(unigram_model()), "▁aabbc")):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(300)]
        cost, ends, _ = m.shortest(texts)
        for t, c, e in zip(texts, cost, ends):
            paths = every_path(m, t)
            least = min(paths)
            assert abs(least[0] - c) < 1e-6
            got = [t[a:b] for a, b in zip([0, *e[:-1]], e)]
            assert got in [p for x, p in paths if abs(x - c) < 1e-6]
            if m.kind == spm_fst.BPE:
                assert len(paths) == 1 and got == m.merged(t) == m.path(t)


def test_normaliser_arcs():
    keep, squeeze = spm_fst.transducer(PIECES), spm_fst.Transducer(unigram_model())
    rng = random.Random(9)
    for _ in range(200):
        t = "".join(rng.choice("  ab\n") for _ in range(rng.randint(0, 8)))
        assert keep.normalised(t) == ("▁" + t.replace(" ", "▁") if t else "")
        assert squeeze.normalised(t) == ("▁" + "▁".join(x for x in t.split(" ") if x) if t.strip(" ") else "")


def test_unigram_models_take_the_least_sum():
    m = spm_fst.Transducer(unigram_model())
    assert m.encode("aba").tolist() == [5, 6]
    assert m.encode("  ab   c ").tolist() == [5, 3, 1, 0] and m.decode(m.encode("aba")) == "aba"


# ---- languages ----


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where("doc_id % 3 <> 0"))
    got = langid.identified(docs.where("doc_id % 3 = 0"), model).join(docs.select("doc_id", "lang"), "doc_id").select("lang", "pred_lang").collect()
    assert np.mean([r[0] == r[1] for r in got]) > 0.99


def test_backoff_and_edges(make):
    train = make([(i, "der hund und katze", "de") for i in range(5)] + [(10 + i, "the dog and cat", "en") for i in range(5)] + [(None, "x", "de"), (30, None, "de"), (31, "zz", None)])
    model = langid.train(train)
    assert model.langs == ("de", "en") and "zz" not in model.words
    got = {r[0]: r[1] for r in langid.identified(make([*EDGES, (50, "hunde"), (51, "dogs the"), (52, "日本"), (53, "KATZE")]), model).collect()}
    assert got[50] == "de" and got[51] == "en" and got[53] == "de" and got[52] in model.langs
    assert got[1] is None and got[2] is None and got[3] is None and None in got
    known = model.rows(["hunde"])[0]
    assert known[0] > known[1]
    even = langid.train(make([(1, "la la", "it"), (2, "la la", "es")]))
    assert [r[1] for r in langid.identified(make([(1, "la"), (2, "lalo")]), even).collect()] == ["es", "es"]
    none = langid.train(make([]))
    assert none.langs == () and langid.identified(train, none).where("pred_lang is not null").count() == 0
    assert langid.identified(make([]), model).count() == 0


def test_languages_equal_brute_force(spark):
    """Training and scores by plain dictionaries over whole texts."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen, asked = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    words, grams = {}, {n: {} for n in langid.ORDERS}
    for text, lang in seen.select("text", "lang").collect():
        own = re.findall(r"\w+", text.lower())
        words.setdefault(lang, Counter()).update(own)
        for n in grams:
            grams[n].setdefault(lang, Counter()).update(g for w in own for m in [f"<{w}>"] for g in (m[i : i + n] for i in range(len(m) - n + 1)))
    langs = sorted(words)

    def logs(tables):
        keys = set().union(*tables.values())
        return {k: [math.log((tables[x][k] + 0.5) / (sum(tables[x].values()) + 0.5 * len(keys))) for x in langs] for k in keys}

    known, parts = logs(words), {n: logs(t) for n, t in grams.items()}

    def one(w):
        if w in known:
            return known[w]
        m = f"<{w}>"
        for n in langid.ORDERS:
            rows = [parts[n][m[i : i + n]] for i in range(len(m) - n + 1) if m[i : i + n] in parts[n]]
            if rows:
                return [sum(c) / len(rows) for c in zip(*rows)]
        return [0.0] * len(langs)

    got = {r[0]: (r[1], r[2]) for r in langid.identified(asked, langid.train(seen)).collect()}
    for i, text in asked.select("doc_id", "text").collect():
        own = re.findall(r"\w+", text.lower())
        if not own:
            assert got[i] == (None, None)
            continue
        means = [sum(c) / len(own) for c in zip(*map(one, own))]
        order = sorted(range(len(langs)), key=lambda j: (-means[j], langs[j]))
        lead = means[order[0]] - means[order[1]]
        assert abs(got[i][1] - lead) < 1e-4 and (got[i][0] == langs[order[0]] or lead < 1e-5)


def test_rare_languages_are_trained(make):
    docs = make([(i, f"common words number {i % 40} of many rows again and again", "aa") for i in range(2000)] + [(5000 + i, "zyx wvu tsr", "zz") for i in range(3)])
    model = langid.train(docs, max_train=50)
    assert model.langs == ("aa", "zz") and all(w in model.words for w in ("zyx", "wvu", "tsr", "again"))
    got = {r["doc_id"]: r["pred_lang"] for r in langid.identified(make([(1, "wvu zyx"), (2, "many rows"), (3, "zyxw")]), model).collect()}
    assert got == {1: "zz", 2: "aa", 3: "zz"}


# ---- secrets ----

HEX = "3c4226790fc3f8022bcc4434e93601b2005f1325"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f'token = "{HEX}" end', [HEX]),
        (f"TOKEN={HEX.upper()}", [f"{HEX.upper()}"]),
        ("key wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY now", ["wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"]),
        (f"sha1: {HEX}", []),
        (f'"commit": "{HEX}"', []),
        ("id a987fbc9-4bed-3078-cf07-9141ba07c9f3", []),
        ("card 4464761703690345 paid", []),
        ("internationalization antidisestablishmentarianism", []),
        ("see https://example.org/x/9f8e7d6c5b4a39281706f5e4d3c2b1a0", []),
        ("mail 9f8e7d6c5b4a39281706@example.org", []),
        ("user_profile_settings_version_2", []),
        ("", []),
    ],
)
def test_secret_cases(text, found):
    enc = secrets.encoder(RANKS)
    got = [text[a:b] for a, b, _ in secrets.find(text, enc)]
    assert [g.removeprefix("TOKEN=") for g in got] == found


TOKEN = "q7Zp2Xv9Lk4Tn8Rw3Yb6Hd1Mc5Jf0GsA"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"clone https://user:{TOKEN}@host/", [TOKEN]),
        (f"clone https://{TOKEN}@host.example.org/x.git", [TOKEN]),
        (f"dsn postgres://svc:{TOKEN}@host/db", [TOKEN]),
        (f"dsn svc:{TOKEN}@db.example.org now", [TOKEN]),
        (f"get https://host/?access_token={TOKEN}", [TOKEN]),
        (f"get https://host/a/b?x=1&access_token={TOKEN}&y=2", [TOKEN]),
        (f"get https://host/cb#access_token={TOKEN}", [TOKEN]),
        (f"get https://host/?key={HEX}", [HEX]),
        (f"hook https://hooks.example.org/services/T0A1/{TOKEN}", [TOKEN]),
        (f"Natasha: {TOKEN}", [TOKEN]),
        (f"git_commit: {HEX}", []),
        (f"please commit {TOKEN}", [TOKEN]),
        (f"TOKEN={TOKEN}", [TOKEN]),
        (f"a=b&c={TOKEN}==", [f"{TOKEN}=="]),
        ("pw Tr0ub4dor&3xyzQ! then", ["Tr0ub4dor&3xyzQ!"]),
        ("key=x7Qp2Lm9vT4z.", ["x7Qp2Lm9vT4z"]),
        ("integrity sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", []),
        ("mail John.Smith99@mail7.Example.com! R&D in Q3-2024?", []),
        ("x=(A1+b2)*c3%D4; if(a&&B1){c!=D2}", []),
        ("version20240101 iphone15promax section_12_b", []),
        (f"get https://host/?sha1={HEX}", []),
        (f"mail mailto:{HEX[:20]}@example.org", []),
        (f"blob https://host/blob/{HEX}/file.py", []),
        (f"at https://{HEX[:20]}.example.org/x", []),
        ("read https://example.org/2024/how-to-train-your-own-model-in-10-steps", []),
    ],
)
def test_secrets_in_addresses(text, found):
    assert [text[a:b] for a, b, _ in secrets.find(text, secrets.encoder(RANKS))] == found


def test_secrets_equal_brute_force(spark):
    """Runs cut sign by sign, tokens merged by rank, over whole texts without addresses."""
    import base64

    import regex

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")

    def tokens(s):
        n = 0
        for part in regex.findall(secrets.PATTERN, s):
            p = [bytes([b]) for b in part.encode()]
            while len(p) > 1:
                best = min(range(len(p) - 1), key=lambda i: ranks.get(p[i] + p[i + 1], 1 << 40))
                if p[best] + p[best + 1] not in ranks:
                    break
                p[best : best + 2] = [p[best] + p[best + 1]]
            n += len(p)
        return n

    want, seen = set(), set()
    for i, text in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        if "://" in text or any(c in text for c in "@!#$%^&*~?"):
            continue
        seen.add(i)
        a = None
        for p in range(len(text) + 1):
            if p < len(text) and text[p] in key:
                a = p if a is None else a
            elif a is not None:
                s = text[a:p]
                start, a = a, None
                if len(s) < 12 or not any(map(str.isalpha, s)) or not any(map(str.isdigit, s)):
                    continue
                per = len(s) / tokens(s)
                named = re.search(r"(?i)(?:md5|sha-?\d*|digest|checksum|commit|etag|revision|fingerprint|integrity)\W{0,4}$", text[:start])
                uuid = [len(x) for x in s.split("-")] == [8, 4, 4, 4, 12]
                if per < (2.3 if len(s) >= 16 else 1.9) and not uuid and not (named and len(s) in (32, 40, 56, 64, 96, 128)):
                    want.add((i, start, p, round(per, 9)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r[0], r[1], r[2], round(r[3], 9)) for r in secrets.secrets(docs, RANKS).collect() if r[0] in seen}
    assert got == want and want


def test_secret_tables(make):
    docs = make([*EDGES, (7, f"a {HEX} b {HEX}"), (7, f"a {HEX} b {HEX}"), (None, HEX)])
    got = rows(secrets.secrets(docs, RANKS))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == [("7", 2, 42), ("7", 2, 42), ("7", 45, 85), ("7", 45, 85), ("None", 0, 40)]
    assert secrets.secrets(docs, RANKS, known=(HEX.upper(),)).count() == 0 == secrets.secrets(make([]), RANKS).count()
    clean = secrets.redacted(docs, RANKS)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[7] == "a [SECRET] b [SECRET]" and texts[None] in ("[SECRET]", "words here") and texts[1] is None and texts[5] == "long " * 60_000


# ---- the registry ----


def test_entry_without_this_subpackage(tmp_path):
    """The rest imports when this subpackage and the pipeline are gone."""
    import shutil
    import subprocess

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "rankloom"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "rankloom/llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert said.returncode == 0 and said.stdout.split()[1] == "False"
