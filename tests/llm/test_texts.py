"""Packing, languages, chat, secrets, quality, URLs, mixing: round trips, brute force and held-out accuracy."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumengrid.llm import chat, cotrain, langid, mixing, packing, quality_rules, secrets, url_filter
from lumengrid.llm.queries import token_path

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Packing


def fills(counts, capacity):
    """All sums of sub-multisets that hold the longest length."""
    longest = max(counts)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n - (k == longest) + 1)}
    return {s + longest for s in sums if s + longest <= capacity}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(30, 64))
def test_fill_is_the_best_subset(counts, capacity):
    chosen, total = packing.fill(counts, capacity)
    assert total == sum(k * n for k, n in chosen.items()) == max(fills(counts, capacity))
    assert all(n <= counts[k] for k, n in chosen.items()) and max(counts) in chosen


def windows_of(pool, lengths, keep=0):
    """All windows of a pool of (name, start, length) pieces, each as the pieces it holds."""
    for k, n in enumerate(lengths):
        pool.add(n, (k, 0, n))
    return list(pool.windows(keep, lambda p, n: ((p[0], p[1], n), (p[0], p[1] + n, p[2] - n))))


def first_fit_cuts(lengths, capacity):
    """Pieces over documents where windows are filled in order of decreasing length, first fit, and slack by cutting."""
    left, cuts = sorted(lengths, reverse=True), 0
    while left:
        room, rest = capacity, []
        for n in left:
            if n <= room:
                room -= n
            else:
                rest.append(n)
        if room and rest:
            rest = sorted([rest[0] - room, *rest[1:]], reverse=True)
            cuts += 1
        left = rest
    return cuts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=80))
def test_windows_are_full_but_the_last(lengths):
    found = windows_of(packing.Pool(64, 10), lengths)
    sizes = [sum(p[2] for p in w) for w in found]
    assert all(x == 64 for x in sizes[:-1]) and sum(sizes) == sum(lengths)
    for k, n in enumerate(lengths):
        at = 0
        for _, start, size in sorted(p for w in found for p in w if p[0] == k):
            assert start == at
            at += size
        assert at == n


def test_least_slack_cuts_fewer_documents_than_first_fit():
    """Lengths that seldom add up by chance: the search finds sums without slack that first fit passes over."""
    rng = random.Random(21)
    short = [min(2047, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(600)]
    for lengths, most in ((short, 0.3), ([rng.randint(300, 700) for _ in range(600)], 0.3), ([rng.randint(600, 760) for _ in range(600)], 0.5), ([rng.randint(1, 2047) for _ in range(600)], 1.1)):
        found = windows_of(packing.Pool(2048, 600), lengths)
        cuts = sum(len(w) for w in found) - len(lengths)
        assert sum(sum(p[2] for p in w) < 2048 for w in found) <= 1
        assert cuts < most * first_fit_cuts(lengths, 2048), (cuts, first_fit_cuts(lengths, 2048))


def pack(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    return packing.pack(df, token_path(), **more).collect()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_path())
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "data", "größer", "<|endoftext|>", "日本", "x" * 40, "\n\n"], k=rng.randint(0, 900)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "tok " * 9000), (503, "same"), (503, "same"), (None, "no id")]
    for capacity in (64, 2048):
        pieces = pack(spark, rows, capacity=capacity, pool=50)
        by_doc = {}
        for p in sorted(pieces, key=lambda p: p.start):
            by_doc.setdefault(p.doc_id, []).append(p)
        for i, text in rows:
            if i != 503:
                ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
                assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in by_doc[i]]).tolist() == ids
                assert np.cumsum([0, *[p.length for p in by_doc[i]]]).tolist()[:-1] == [p.start for p in by_doc[i]]
                assert all(p.doc_tokens == len(ids) and 4 * p.length == len(p.ids) for p in by_doc[i])
        assert len(by_doc[503]) == 2
        by_seq = {}
        for p in pieces:
            by_seq.setdefault(p.sequence_id, []).append(p)
        padding = 0
        for seq in by_seq.values():
            at = 0
            for p in sorted(seq, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= capacity
            padding += 0 if at & (at - 1) == 0 else capacity - at
        assert padding == 0


def test_packing_of_nothing(spark):
    assert pack(spark, []) == []


def test_both_token_engines_agree(spark):
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(token_path()), packing.tokenizer(token_path())
    rng = random.Random(2)
    letters = [chr(c) for c in [*range(32, 127), 9, 10, 13, *range(0xA1, 0xAD), *range(0xAE, 0x250), 0x2019, 0x2026, 0x3042, 0x85, 0]] + [" "] * 60 + list("etaoin") * 9
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(2000)] + [" " * 50_000 + "x", "a" * 50_000, "it's I'LL", "a<|endoftext|>b", "x" * 250_000]
    assert encode(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


# Languages


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).where("held_out and lang_pred <> 'und'").select("lang", "lang_pred", "score", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.02


def test_language_of_odd_rows(spark):
    rows = [(i, "the of and with this that " * 5 + str(i), "en", "s", 1) for i in range(40)] + [(100 + i, "der und nicht ein mit für " * 5, "de", "s", 1) for i in range(40)]
    rows += [(200, None, "en", "s", 1), (201, "", None, "s", 1), (202, "12 !? 34", "en", None, None), (None, "und nicht der mit " * 9, None, None, None), (203, "the and with " * 200_000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202, None, 203)] == ["und", "und", "und", "de", "en"]
    assert got[200].rejected and got[200].score == 0 and got[None].held_out and len(got) == 85
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "text", None, "s", 1)], DOCS)).collect()] == ["und"]


def test_language_ignores_label_and_source(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = langid.train(langid.training_sample(docs, F.col("lang"), 200, 500))
    a = langid.predict(docs, model).select("doc_id", "lang_pred", "score").collect()
    b = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_subwords_of_parts_are_those_of_the_whole():
    rng = random.Random(19)
    for _ in range(60):
        texts = ["".join(rng.choices("abCé  12 日", k=rng.randint(0, 60))).encode() for _ in range(rng.choice([1, 1, 4]))]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        whole = sorted(zip(*map(np.ndarray.tolist, langid.subwords(data, offsets, 997)), strict=True))
        for most in (1, 2, 7, 30):
            found = [x for part in langid.parts(data, offsets, 997, most) for x in zip(*map(np.ndarray.tolist, part), strict=True)]
            assert sorted(found) == whole


def test_scores_equal_brute_force(spark):
    """The scoring pass, from the model's tables, text by text and run by run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = langid.train(langid.training_sample(docs, F.col("lang"), 200, 500), buckets=1 << 12)
    rows = [(i, t) for i, t in enumerate(["the and of", "Der  Und\tnicht 12", "é", "x" * 5000, "日本語 の text", "a\n\n b"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unknown": F.lit(1), "unseen": F.lit(2), "__unknown": F.lit(3)})
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, t in rows:
        low = re.sub(r" +", " ", "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in t)).encode()
        z, n = np.zeros(len(model.languages)), 0
        for size in range(1, 5):
            for a in range(len(low) - size + 1):
                (bucket,) = langid.hashed(np.frombuffer(low[a : a + size], np.uint8), np.zeros(size, np.int32), 1 << 12 << 6, size)[0][-1:]
                z, n = z + model.logits[bucket % (1 << 12)], n + 1
        z = (z / n + model.bias) / model.temperature
        p = np.exp(z - z.max())
        assert (got[i].lang_pred, got[i].unknown, got[i].unseen) == (model.languages[int(p.argmax())], 1, 2) and abs(got[i].score - p.max() / p.sum()) < 1e-4


# Chat

texts_strategy = st.lists(st.sampled_from([*"ab\\<>/\n ", "<turn ", "</turn>", "\n</turn>\n", "\\<", "user", "é", "日"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(texts_strategy, texts_strategy), max_size=4))
def test_chat_round_trip(turns):
    parts = [chat.render(r, t) for r, t in turns]
    assert chat.parse_all("".join(p[0] for p in parts)) == turns
    assert [chat.unescape(out[a:b]) for out, a, b in parts] == [t for _, t in turns]


def test_chat_leaves_plain_text_alone():
    assert chat.render("user", "a < b </turn> c")[0] == "<turn user>\na < b </turn> c\n</turn>\n"
    assert "\\</turn>" in chat.render("user", "x\n</turn>\ny")[0]


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, None, None, None), (None, 0, "assistant", "x"), (1, 1, "assistant", "two"), (3, 0, "assistant", "é\\" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256, got[1].loss_chars) == (3, sha("user\none\nassistant\ntwo\nassistant\ntwo\n"), sha("twotwo"), 6)
    assert (got[2].turns_sha256, got[2].loss_chars, got[None].loss_sha256) == (sha("\n\n"), 0, sha("x"))
    assert got[3].loss_chars == 100_000 and got[3].formatted_chars > 150_000
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# Secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans_equal_re(spark):
    rng = random.Random(3)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef", "123456", "AKIA", "ABCDEFGH01234567", "0123456789abcdef01234567", "\n", "é", "😀", "==", "-_.", "x"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(600)] + [(900, None), (901, ""), (902, "word " * 100_000 + "secret: hunter22"), (903, "secret: hunter22")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = secrets.scan(df).select("doc_id", "text", secrets.said(F.col("base")).alias("said"), secrets.said(F.col("spans")).alias("more")).collect()
    assert len(got) == len(rows) and [r for r in got if r.said != base_spans(r.text or "")] == []
    assert all(set(filter(None, r.said.split(","))) <= set(r.more.split(",")) for r in got)
    assert secrets.scan(df.limit(0)).count() == 0


def test_battery_finds_random_strings_and_spares_names(spark):
    rng = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(b64[:62] if i % 2 else b64, k=rng.choice([32, 40, 64]))) for i in range(60)]
    names = ["internationalization", "getElementsByTagNameAndClass", "this-is-a-rather-long-url-slug-about-things", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "path/to/some/file/in/a/folder", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678901234567890123", "AnotherLongCamelCaseIdentifierName"] * 10
    rows = [(i, f"see {x} here") for i, x in enumerate(keys + names)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("spans").alias("n"), secrets.said(F.col("spans")).alias("s")).collect()
    hit = {r.doc_id for r in found if r.n}
    assert len([i for i in range(60) if i in hit]) >= 55 and not [i for i in range(60, len(rows)) if i in hit]
    assert all(re.fullmatch("random:4:[0-9]+", r.s) for r in found if r.n)


def tail(z):
    p = min(math.exp(-0.717 * abs(z) - 0.416 * z * z), 1.0) / 2
    return max(p if z >= 0 else 1 - p, 1e-290)


def battery(t, alphabet):
    """The three tests in numpy."""
    n, size, x = len(t), len(alphabet), np.array([alphabet.index(c) for c in t], float)
    chi = sum((t.count(c) - n / size) ** 2 / (n / size) for c in alphabet)
    d, high = x - x.mean(), x >= size / 2
    serial = ((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9) + 1 / n) * n**0.5
    expected = 2 * high.sum() * (n - high.sum()) / n
    runs = ((high[1:] != high[:-1]).sum() - expected) / max(expected * (expected - 1) / (n - 1), 0.25) ** 0.5
    return 3 * min(tail((chi - size + 1) / (2 * size - 2) ** 0.5), 2 * tail(abs(serial)), 2 * tail(abs(runs)))


def text_p(t):
    n, u = len(t), t.replace("-", "+").replace("_", "/")
    pairs = sum(u.count(c) * (u.count(c) - 1) for c in set(u)) / (n * (n - 1))
    kind = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else " " for c in t]
    mixed = (sum(a != b for a, b in zip(kind, kind[1:], strict=False)) - 0.15 * (n - 1)) / (0.15 * 0.85 * (n - 1)) ** 0.5
    return tail(((0.065 - pairs) / (0.12 / n**0.5) + mixed) / 2**0.5)


def tenths_of(t):
    alphabet = next((a for a, p in secrets.ENCODINGS if re.match(p, t)), None)
    p = battery(t, alphabet) if alphabet else battery(t.replace("-", "+").replace("_", "/"), secrets.BASE64)
    return max(math.floor(min(-math.log10(text_p(t) / min(len(t) / 32, 4)) * 10, 3000)), 0) if p >= 0.001 else -1


def test_battery_equals_brute_force(spark):
    rng = random.Random(14)
    alphabets = [a for a, _ in secrets.ENCODINGS] + [secrets.BASE64, secrets.BASE64 + "-_", "ab", "aB3", "erstnichtheit"]
    texts = ["".join(rng.choices(a, k=rng.randint(20, 150))) for a in alphabets for _ in range(25)] + ["z" * 40, "ab" * 30, "A1" * 20]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(secrets.evidence(F.col("t")).alias("e")).collect()
    assert [(t, r.e) for t, r in zip(texts, got, strict=True) if abs(r.e - tenths_of(t)) > (0 if r.e < 0 else 1)] == []


def test_discoveries_equal_weighted_benjamini_hochberg(spark):
    """What the patterns cover is no candidate; the rest are found as by the rule with weights of mean 1."""
    rng = random.Random(15)
    words = ["einheit", "keiten", "lich", "berg", "tion", "Thing", "some", "path/", "v2", "_x"]
    texts = ["".join(rng.choices(words, k=9)) for _ in range(150)] + ["".join(rng.choices(secrets.BASE64, k=rng.choice([24, 32, 44, 64]))) for _ in range(25)]
    covered = ["token = " + "".join(rng.choices(secrets.BASE64[:62], k=40)) for _ in range(400)]
    rows = [(i, f"a {t} b") for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(covered)]
    weights = [min(len(t) / 32, 4) for t in texts]
    mean = sum(weights) / len(weights)
    p = [text_p(t) * mean / w if tenths_of(t) >= 0 else 1.0 for t, w in zip(texts, weights, strict=True)]
    ranked = sorted(p)
    limit = max([x for k, x in enumerate(ranked, 1) if len(p) * x <= 0.001 * k], default=-1)
    got = {r.doc_id: r.s for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.said(F.col("spans")).alias("s")).collect()}
    found, want = {i for i in range(len(texts)) if got[i]}, {i for i, x in enumerate(p) if x <= limit}
    assert len(want) >= 20 and found <= want and len(want - found) <= 1  # tenths round down
    assert all(got[1000 + i].startswith("assign:") and "random" not in got[1000 + i] for i in range(len(covered)))


def test_random_span_that_holds_a_pattern_is_added(spark):
    rng = random.Random(16)
    key = "".join(rng.choices(secrets.BASE64[:62], k=150)) + "Z4f8a1c9e3b7d2065e8f1a3c7Z" + "".join(rng.choices(secrets.BASE64[:62], k=150))
    df = spark.createDataFrame([(1, f"see {key} end"), (2, "plain words")], "doc_id long, text string")
    (row,) = secrets.scan(df, false_share=1.0).where("doc_id = 1").select(secrets.said(F.col("base")).alias("b"), secrets.said(F.col("spans")).alias("s"), secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert (row.b, row.s, row.t) == ("hex:155:179", f"random:4:{4 + len(key)},hex:155:179", "see [SECRET] end")


def test_redaction(spark):
    rows = [(1, "é secret: abcdef0123456789abcdef0123 z"), (2, "plain"), (3, None)]
    df = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.t for r in df.select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [SECRET] z", 2: "plain", 3: None}


# Quality


def figures(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_figures_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(["a ", "b ", "é ", "word ", "#", "\n", "\t", "\x0b", "<x> ", "😀 "], k=rng.randint(0, 150))), "s", 1) for i in range(200)]
    rows += [(900, None, None, None), (901, "", "s", 0), (902, "x y z " * 20_000, "s", 1), (903, "one two three\n" * 3, None, 1)]
    df = spark.createDataFrame([(i, t, "en", s, n) for i, t, s, n in rows], DOCS).withColumn("host", F.lit("clash")).withColumn("salt", F.lit(1))
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, t, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (figures(t) if i != 902 else (60_000, 60_000, 0, 0, 60_000)), i
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, good if i % 2 else bad if i % 20 == 0 else good, "en", f"good{i % 7}", 1) for i in range(700)]
    rows += [(1000 + i, bad if i % 10 else good, "en", "spam", 1) for i in range(200)] + [(2000, bad, "en", "tiny", 1), (2001, good, "en", "tiny", 1)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[1000] and not got[1010] and got[2001] and got[1]


def test_host_verdicts_fire_on_planted_hosts_alone(spark, monkeypatch):
    """At sf0.01 no source is worse than chance allows, so none goes; a planted one takes its good documents with it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert quality_rules.judge(docs).where("host_dropped").count() == 0
    bad = F.when(F.col("doc_id") % 25 == 3, F.lit("farm")).otherwise(F.col("source"))
    spoiled = docs.withColumn("source", bad).withColumn("text", F.when((F.col("source") == "farm") & (F.col("doc_id") % 4 > 0), "buy now").otherwise(F.col("text")))
    figures = ["doc_id", "host_docs", "host_failures", "host_dropped", "kept"]
    got = sorted(quality_rules.judge(spoiled).where("host = 'farm' or not host_dropped").select("host", "base_failed", *figures).collect())
    farm = [r for r in got if r.host == "farm"]
    assert len(got) == 1000 and len(farm) == 40 and all(r.host_dropped and not r.kept and r.host_docs == 40 for r in farm)
    assert sum(not r.base_failed for r in farm) > 0 and all(r.kept != r.base_failed for r in got if r.host != "farm")
    monkeypatch.setattr(quality_rules, "FEW_HOSTS", 0)  # the salted join gives the same rows
    assert sorted(quality_rules.judge(spoiled).select("host", "base_failed", *figures).collect()) == got


def test_cotraining_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 2 = 0")
    rows = cotrain.classify(docs, fit).join(labels.where("doc_id % 2 = 1"), "doc_id").select("score", "quality", "kept").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_cotraining_of_odd_rows(spark):
    rows = [(i, "fine words in order here " * 9 if i % 2 else "BAD!! WORDS!! " * 20, "en", "s", 1) for i in range(60)] + [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "fine words", "en", "s", 1), (1, "fine words in order here " * 9, "en", "s", 1), (102, "fine " * 500_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(999, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = cotrain.classify(docs, labels).collect()
    assert len(got) == len(rows) and {r.doc_id: r.kept for r in got}[51] and not {r.doc_id: r.kept for r in got}[52]
    assert {r.score for r in cotrain.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert cotrain.classify(docs.limit(0), labels).count() == 0


def test_cotraining_scores_equal_brute_force(spark):
    """The scoring pass over long texts in parts, against both views made text by text."""
    rng = np.random.default_rng(20)
    model = cotrain.Views(rng.normal(size=cotrain.BUCKETS + 3), rng.normal(size=cotrain.META + 1) / 9, np.array([0.5, 0.1]), np.array([0.4, -0.2]), np.array([0.7, 0.6, 0.05]))
    rows = [(0, "", "en", "s", 1), (1, "one Two two 33!\n#x", "de", None, 1), (2, "ab c " * 420_000, None, "t", 1), (3, "é", "en", "s", 1)]
    got = {r.doc_id: r for r in cotrain.score(spark.createDataFrame(rows, DOCS), model).collect()}
    for i, t, lang, source, _ in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        counts = np.zeros(cotrain.BUCKETS)
        short = t.encode() if len(t) < 1000 else None
        if short is None:  # a text of one period: its runs from the counts of a whole number of periods
            counts = np.bincount(cotrain.runs(data, offsets)[0], minlength=cotrain.BUCKETS)
        else:
            for n in range(1, 4):
                for a in range(len(short) - n + 1):
                    counts[cotrain.runs(np.frombuffer(short[a : a + n], np.uint8), np.array([0, n]))[0][-1]] += 1
        views = []
        for z, m in ((counts @ model.content[: cotrain.BUCKETS] / max(counts.sum(), 1) + cotrain.variety(data, offsets)[0] @ model.content[cotrain.BUCKETS : -1] + model.content[-1], model.content_map), (cotrain.metadata(data, offsets, [source], [lang])[0] @ model.meta[:-1] + model.meta[-1], model.meta_map)):
            views.append(np.clip(z * m[0] + m[1], -cotrain.MOST, cotrain.MOST))
        want = 1 / (1 + np.exp(-np.array([*views, views[0] * model.final[0] + views[1] * model.final[1] + model.final[2]])))
        assert np.allclose([got[i].text_score, got[i].meta_score, got[i].score], want, atol=1e-6)


def test_training_sample_has_one_row_of_each_id(spark):
    rows = [(i % 40, f"text {i}", "en", "s", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    ids, views = cotrain._sample(docs, list(range(40)))
    again, more = cotrain._sample(docs.orderBy(F.desc("text")).repartition(7), list(range(40)))
    assert ids == again == list(range(40)) and all((a == b).all() for a, b in zip(views, more, strict=True))


# URLs


def rule_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[2], max(fits)[3]) if fits else (None, None))


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["http", "://", "www.", "example.org", "Example.COM", "net", "com", "/", "es/", "en/1", "fr/", "de/", "?q=1", "#f", "x", "é", "\n"]
    urls = ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(500)] + ["http://a.example.org/en/1", "https://com/fr/x", "http://org", "ftp://xorg/", None, "", "no scheme/", "http://h/" + "p/" * 30_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.judge(df, rounds=2).collect():
        host, path, rule, verdict = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_trees_learn_from_labels(spark):
    rng = random.Random(7)
    rows = [(f"http://a{i}.example.org/es/{rng.randint(0, 9)}?a=1&b=2&c=3" if i % 2 else f"http://b{i}.site.org/page", f"{'a' if i % 2 else 'b'}{i}.{'example' if i % 2 else 'site'}.org", i % 2) for i in range(400)]
    model = url_filter.boost(spark.createDataFrame(rows, "url string, host string, y int"), rounds=4)
    scored = url_filter.with_features(spark.createDataFrame(rows, "url string, host string, y int"), model).select("y", model.score().alias("s")).collect()
    assert len(model.trees) == 4 and all((r.s > 0) == (r.y == 1) for r in scored)


def grown(x, y, edges, rounds, rate=0.3):
    """Trees of depth two, every cut tried by masks: (feature, edge, left, right)."""
    prior = (y.sum() + 1) / (len(y) + 2)
    z, trees = np.full(len(y), math.log(prior / (1 - prior))), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)

        def best(rows):
            found = None
            for k in range(x.shape[1]):
                for e, edge in enumerate(edges[k]):
                    low, high = rows & (x[:, k] <= edge), rows & (x[:, k] > edge)
                    gain = sum(s * g[m].sum() ** 2 / (h[m].sum() + 1) for m, s in ((low, 1), (high, 1), (rows, -1)))
                    if found is None or gain > found[0] + 1e-9:
                        found = (gain, k, e, *(rate * g[m].sum() / (h[m].sum() + 1) for m in (low, high)))
            return found[1:] if found and found[0] > 1e-6 else None

        root = best(np.ones(len(y), bool))
        if root is None:
            break
        low = x[:, root[0]] <= edges[root[0]][root[1]]
        sides = [best(m) if m.any() else None for m in (low, ~low)]
        for m, s, flat in ((low, sides[0], root[2]), (~low, sides[1], root[3])):
            z = z + np.where(m, flat if s is None else np.where(x[:, s[0]] <= edges[s[0]][s[1]], s[2], s[3]), 0)
        trees.append((*root[:2], *(s or root[2 + i] for i, s in enumerate(sides))))
    return trees, z


def test_trees_equal_brute_force(spark):
    rng = random.Random(17)
    rows = []
    for i in range(300):
        host = f"{rng.choice(['a', 'shop', 'x-y', 'w1'])}{i % 40}.{rng.choice(['com', 'org', 'net', 'de', 'info'])}"
        url = f"http://{host}/" + "/".join(rng.choices(["p", "item", "12", "a-b-c"], k=rng.randint(0, 5))) + rng.choice(["", "?q=1", "?a=1&b=2"])
        rows.append((url, host, int(rng.random() < (0.8 if "?" in url or host.endswith("info") else 0.2))))
    df = spark.createDataFrame(rows, "url string, host string, y int")
    model = url_filter.boost(df, rounds=4)
    got = url_filter.with_features(df, model, training=True).select("url", "y", *url_filter.FEATURES, model.score().alias("s")).collect()
    x, y = np.array([[r[f] for f in url_filter.FEATURES] for r in got], float), np.array([r.y for r in got], float)
    trees, z = grown(x, y, model.edges, 4)
    flat = lambda t: [v for part in t for v in (flat(part) if isinstance(part, tuple) else [part])]
    assert len(model.trees) == 4 and all(np.allclose(flat(a), flat(b), atol=1e-9) for a, b in zip(model.trees, trees, strict=True))
    assert np.allclose([r.s for r in got], z, atol=1e-9)
    folds = {r["url"]: r["f"] for r in df.select("url", F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)).alias("f")).collect()}
    suffix = lambda u: u.split("/")[2].rsplit(".", 1)[-1]
    for r in got:  # figures of the other folds: a row's own label is not in them
        rest = [k for u, _, k in rows if suffix(u) == suffix(r.url) and folds[u] != folds[r.url]]
        assert abs(r.suffix_rate - (sum(rest) + 10 * model.prior) / (len(rest) + 10)) < 1e-9 and abs(r.suffix_share - len(rest) / 300) < 1e-9
    for r in url_filter.with_features(df, model).collect():  # to score, all count
        every = [k for u, _, k in rows if suffix(u) == suffix(r.url)]
        assert abs(r.suffix_rate - (sum(every) + 10 * model.prior) / (len(every) + 10)) < 1e-9 and abs(r.suffix_share - len(every) / 300) < 1e-9


def test_suffixes_teach_what_holds_for_other_urls(spark):
    """Suffixes that say much lower the held-out loss; where each row has a suffix of its own, they do no harm."""
    rng = random.Random(21)
    schema = "url string, host string, y int"

    def losses(rows):
        fit, held = spark.createDataFrame(rows[:600], schema), spark.createDataFrame(rows[600:], schema)
        return [url_filter.log_loss(held, url_filter.boost(fit, rounds=5, suffixes=s)) for s in (True, False)]

    def rows(tail):
        hosts = [f"h{i}.{tail(i)}" for i in range(900)]
        return [(f"http://{h}/p", h, int(rng.random() < (0.9 if h.endswith(("cdab", "dabc")) else 0.1 if h.endswith(("abcd", "bcda")) else 0.5))) for h in hosts]

    told, untold = losses(rows(lambda i: rng.choice(["abcd", "bcda", "cdab", "dabc"])))
    assert told < untold - 0.1
    told, untold = losses(rows(lambda i: f"suffix{i}"))
    assert told < untold + 0.02


# Mixing


def water(budget, children):
    """children: {name: (capacity, weight)}: shares by repeated redistribution."""
    got, left, budget = {}, dict(children), min(budget, sum(c for c, _ in children.values()))
    while left:
        level = budget / sum(w for _, w in left.values())
        full = {k for k, (c, w) in left.items() if c <= w * level}
        if not full:
            return got | {k: w * level for k, (_, w) in left.items()}
        for k in full:
            got[k] = left.pop(k)[0]
            budget -= got[k]
    return got


def test_mixture_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["en", "en", "en", "de", None]), rng.choice(["src0", "src0", "src0", "src1", "src2", "src5", "x", None]), 1) for i in range(600)]
    rows += [(7, "w w", "en", "src0", 1), (None, "w", "en", "src0", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("clash")).withColumn("place", F.lit(1))
    got = mixing.mix(df, F.expr(mixing.DOMAIN_SQL), mixing.word_count(F.col("text")), {"domain": mixing.level_weight("domain", mixing.DOMAIN_WEIGHTS), "language": mixing.level_weight("language", mixing.LANGUAGE_WEIGHTS)}, bucket_rows=8).collect()
    assert len(got) == len(rows)
    leaves = {}
    for r in got:
        leaves.setdefault((r.domain, r.language, r.origin), []).append(r)
    size = {k: sum(r.tokens for r in v) for k, v in leaves.items()}
    budgets = {(): 0.8 * sum(size.values())}
    for depth, weights in ((1, mixing.DOMAIN_WEIGHTS), (2, mixing.LANGUAGE_WEIGHTS), (3, None)):
        nodes = sorted({k[:depth] for k in leaves})
        for parent in {n[:-1] for n in nodes}:
            children = {n: (2.0 * sum(s for k, s in size.items() if k[:depth] == n), weights.get(n[-1], 0.05) if weights else 1.0) for n in nodes if n[:-1] == parent}
            budgets |= water(budgets[parent], children)
    for k, v in leaves.items():
        budget = int(budgets[k] + 1e-6)
        whole = budget // size[k] if size[k] else 2
        order = {}
        for r in v:
            order.setdefault((hashlib.md5(f"17:{whole}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id), []).append(r)
        used, rest = 0, budget - whole * size[k]
        for key in sorted(order, key=lambda x: (x[0], x[1] if x[1] is not None else -1)):
            used += sum(r.tokens for r in order[key])
            assert all(r.copies == whole + (rest > 0 and used <= rest) for r in order[key]), (k, key)
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_mixture_of_columns_with_clashing_names(spark):
    rng = random.Random(18)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["en", "de"]), rng.choice(["src0", "src1"]), 1) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    weights = {"domain": mixing.level_weight("domain", mixing.DOMAIN_WEIGHTS)}
    want = sorted(map(tuple, mixing.mix(df, F.expr(mixing.DOMAIN_SQL), mixing.word_count(F.col("text")), weights).select("doc_id", "domain", "tokens", "copies").collect()))
    named = df.withColumns({"domain": F.expr(mixing.DOMAIN_SQL), "tokens": mixing.word_count(F.col("text"))})
    clash = ["whole", "partial", "rest", "stop_place", "stop_id", "bucket", "place", "salt", "budget", "__mix_whole", "__mix_tokens", "a.b"]
    for c in clash:
        named = named.withColumn(c, F.lit(c))
    got = mixing.mix(named, F.col("domain"), F.col("tokens"), weights)
    assert sorted(map(tuple, got.select("doc_id", "domain", "tokens", "copies").collect())) == want
    assert {tuple(r) for r in got.select(*[f"`{c}`" for c in clash]).collect()} == {tuple(clash)}


def test_mixture_with_salted_leaves_is_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    one = sorted(map(tuple, mixing.mix_documents(docs).select("doc_id", "copies").collect()))
    monkeypatch.setattr(mixing, "FEW_LEAVES", 0)
    assert sorted(map(tuple, mixing.mix_documents(docs).select("doc_id", "copies").collect())) == one


@pytest.mark.parametrize("name", ["op3_secret_scan", "op6_quality_rules", "op7_url_filter"])
def test_native_plans_run_no_python(spark, name):
    from lumengrid.llm.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
