"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd inputs."""

import bisect
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.functions.tables import shared_dir
from tracewell.llm import audio, language, minhash, mixing, packing, quality_model, quality_rules, secrets_scan, sharding, token_files
from tracewell.llm.components import connected_components
from tracewell.llm.numbering import number_rows
from tracewell.llm.queries import QUERIES
from tracewell.llm.tokens import crc32_of, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, node string, band string, kind string, n string, rank string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def odd_rows():
    """Null in any column, empty and long texts, ties, repeated rows; columns with names that operators use."""
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "épée", "日本", "x1", "THE", "the."]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = text(60)
    texts = [None, "", "  \n\t ", "one", "one two", base, base, base.replace("alpha", "ALPHA", 1), base + " tail", text(4000), "x" * 5000, "word\n" * 50, "é" * 100, "12 34 !!", text(30), 'token = "abcdef0123456789abcdef0123456789"', "😀 <|endoftext|> a  <|endoftext|>", "a b c  d"]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s2", 3), (5, texts[5], "en", "s2", 3), (None, "no id", None, None, None), (None, "no id", None, None, None), (70, None, None, None, None)]
    return [(*r, "size", "row", "node", "band", "kind", "n", "rank") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(df):
    return df.select("doc_id", "text").collect()


# Language


def test_language_held_out_accuracy(docs):
    out = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_language_counts_equal_a_dictionary():
    text = "Abba bab"
    for text in (text, text * 3000):  # few and many n-grams are counted in two ways
        at, n = language.ngram_counts(text)
        want = collections.Counter()
        for k in range(3):
            for i in range(len(text) - k):
                code = 0
                for c in text[i : i + k + 1].lower():
                    code = (code * language._HASH[0]) & 0xFFFFFFFF ^ (ord(c) * language._HASH[1]) & 0xFFFFFFFF
                want[((code + k) * language._HASH[2] & 0xFFFFFFFF) >> (32 - language.BITS)] += 1
        assert dict(zip(at.tolist(), n.tolist())) == want


def test_language_scores_equal_a_plain_sum(docs):
    model = language.fit(docs)
    for r in docs.limit(20).collect():
        at, n = language.ngram_counts(r.text)
        x = {int(a): float(c * model.idf[a]) for a, c in zip(at, n)}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        z = [sum(v * model.weights[a, k] for a, v in x.items()) / norm / model.temperature for k in range(len(model.languages))]
        e = [math.exp(v - max(z)) for v in z]
        name, score = model.predict(r.text)
        assert name == model.languages[e.index(max(e))] and abs(score - max(e) / sum(e)) < 1e-9


def test_language_learns_from_a_repeated_row_once(spark, docs):
    plain = docs.select("doc_id", "text", "lang")
    one = plain.where(~language.held_out()).orderBy(F.xxhash64("text", "lang", F.lit(1))).limit(1)
    many = plain.union(one.crossJoin(spark.range(10_000)).drop("id"))
    model = language.fit(many, sample=150)
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95


@pytest.mark.parametrize("text", ["½", "①②", "²", "Ⅷ", "12 _", ""])
def test_text_without_letters_has_no_language(text):
    assert language.Model(["en"], np.ones(1 << language.BITS), np.ones((1 << language.BITS, 1))).predict(text) == ("und", 0.0)


def test_language_odd(odd, none, docs):
    model = language.fit(docs)
    out = {(r.doc_id): r for r in language.predict(odd, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 13, 70)) and out[12].lang_pred != "und"
    assert language.predict(none, language.fit(none)).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.fit(none)).collect()} == {"und"}


def test_temperature_calibrates():
    draw = np.random.default_rng(1)
    target = draw.integers(0, 2, 4000)
    logits = np.zeros((4000, 2))
    right = draw.random(4000) < 0.8
    logits[np.arange(4000), np.where(right, target, 1 - target)] = 6.0
    assert abs(6.0 / language.temperature(logits, target) - math.log(0.8 / 0.2)) < 0.3


# Packing


def expected_pieces(rows):
    e, out = encoder(token_files.default_tokenizer()), collections.Counter()
    for i, text in rows:
        ids = np.array(e.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        count = -(-len(ids) // 2048)
        lead, at = len(ids) - (count - 1) * 2048, 0
        for p in range(count):
            n = lead if p == 0 else 2048
            out[i, p, at, n, crc32_of(ids[at : at + n])] += 1
            at += n
    return out


def check_packing(out, rows):
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected_pieces(rows)
    at = collections.defaultdict(list)
    for r in out:
        at[r.sequence_id].append((r.offset, r.length))
    for held in at.values():
        upto = 0
        for offset, n in sorted(held):
            assert offset == upto
            upto += n
        assert upto <= 2048
    return len(at)


def test_packing_is_whole_and_tight(docs):
    rows = [(r.doc_id, r.text) for r in pairs_of(docs)]
    out = packing.packed(docs, token_files.default_tokenizer()).collect()
    used, least = check_packing(out, rows), -(-sum(r.length for r in out) // 2048)
    assert used <= 1.02 * least + 1


def test_packing_tasks_forget_their_pieces(spark, docs):
    """Workers wait for their next task beside what the pipeline's next stage runs, so they hold no pieces then."""
    path = token_files.default_tokenizer()

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(encoder(path).known)]})

    assert packing.pieces(docs, path).count() > 0
    assert spark.range(400).repartition(4).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_packing_odd(odd, none):
    check_packing(packing.packed(odd, token_files.default_tokenizer()).collect(), [(r.doc_id, r.text) for r in pairs_of(odd)])
    assert packing.packed(none, token_files.default_tokenizer()).count() == 0


def test_best_fit_places_every_document_once(spark):
    draw = random.Random(2)
    counts = {n: draw.randint(1, 9) for n in draw.sample(range(1, 101), 40)}
    puts = packing.best_fit(spark.createDataFrame(list(counts.items()), "length long, n long"), 100).collect()
    ranks, room = collections.defaultdict(list), collections.defaultdict(list)
    for p in puts:
        for k in range(p.n):
            ranks[p.size].append(p["at"] + k)
            room[p.bin + k].append((p.offset, p.size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for held in room.values():
        upto = 0
        for offset, size in sorted(held):
            assert offset == upto
            upto += size
        assert upto <= 100


def plain_best_fit(lengths, capacity):
    """Sequences of best-fit decreasing, one document at a time."""
    rooms, used = [], 0
    for size in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, size)
        if i == len(rooms):
            used += 1
            rest = capacity - size
        else:
            rest = rooms.pop(i) - size
        bisect.insort(rooms, rest)
    return used


@pytest.mark.parametrize("shape", ["wide", "small", "halves", "thirds", "one"])
def test_packing_is_about_as_tight_as_plain_best_fit(spark, shape):
    draw = random.Random(shape)
    sizes = {
        "wide": [draw.randint(1, 2048) for _ in range(4000)],
        "small": [int(draw.expovariate(1 / 150)) % 2048 + 1 for _ in range(6000)],
        "halves": [draw.randint(900, 1100) for _ in range(1500)],
        "thirds": [draw.randint(600, 720) for _ in range(1500)],
        "one": [700] * 5000 + [3] * 10,
    }[shape]
    counts = list(collections.Counter(sizes).items())
    puts = packing.best_fit(spark.createDataFrame(counts, "length long, n long")).collect()
    used = max(p.bin + p.n for p in puts)
    assert sum(p.n for p in puts) == len(sizes) and used <= 1.01 * plain_best_fit(sizes, 2048) + 1
    assert len(puts) <= 40 * len(counts) + 100


def plain_sweep(docs, gaps):
    """One by one: from the largest size down, gaps before documents of their size, a document takes the gap last come by.

    docs are sizes, gaps rooms; what a document leaves of a gap is a gap again. Returns placed (size, room), and what is left.
    """
    ahead = sorted([(-g, 0) for g in gaps] + [(-d, 1) for d in docs])
    stack, placed, left = [], [], []
    while ahead:
        size, is_doc = ahead.pop(0)
        if not is_doc:
            stack.append(-size)
        elif not stack:
            left.append(-size)
        else:
            room = stack.pop()
            placed.append((-size, room))
            if room + size:
                bisect.insort(ahead, (-(room + size), 0))
    return placed, left, stack


def as_runs(docs, gaps):
    doc_runs = [("doc", s, n, 0, 0, 0) for s, n in collections.Counter(docs).items()]
    return doc_runs + [("gap", s, 1, 0, k, 0) for k, s in enumerate(gaps)]


def expanded(runs):
    puts = sorted(size for kind, size, n, *_ in runs if kind == "put" for _ in range(n))
    return puts, sorted(s for kind, s, n, *_ in runs if kind == "doc" for _ in range(n)), sorted(s for kind, s, n, *_ in runs if kind == "gap" for _ in range(n))


def test_sweeps_follow_their_rule():
    """Sweeps of runs equal sweeps one by one, with sizes whose remainders are used again, by ranges and over what they leave."""
    draw = random.Random(9)
    for _ in range(200):
        docs = [draw.randint(1, 2048) for _ in range(60)]
        gaps = [draw.randint(1, 2048) for _ in range(60)]
        got = expanded(packing.sweep(as_runs(docs, gaps), 2048))
        placed, left, rooms = plain_sweep(docs, gaps)
        assert got == (sorted(s for s, _ in placed), sorted(left), sorted(rooms))
        # Two ranges, then all that is left.
        parts = [[x for x in xs if (x > 1024) == high] for high in (False, True) for xs in (docs, gaps)]
        state = [r for d, g in ((parts[0], parts[1]), (parts[2], parts[3])) for r in packing.sweep([("gap", s, 1, 0, gaps.index(s), 0) if k else ("doc", s, 1, 0, 0, 0) for k, xs in enumerate((d, g)) for s in xs], 2048)]
        low, high = plain_sweep(parts[0], parts[1]), plain_sweep(parts[2], parts[3])
        last = plain_sweep(low[1] + high[1], low[2] + high[2])
        assert expanded(packing.sweep(state, 2048)) == (sorted(s for p in (low, high, last) for s, _ in p[0]), sorted(last[1]), sorted(last[2]))
        # Nothing that still seeks a gap fits into one that is left.
        assert not last[1] or not last[2] or min(last[1]) > max(last[2])


# Mixing


def test_mixing_meets_targets(odd, none):
    out = mixing.mixed(odd).collect()
    assert len(out) == odd.count()
    sizes, targets = collections.defaultdict(int), {}
    for i, text, source in [(r.doc_id, r.text, r.source) for r in odd.collect()]:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_ = sum(sizes.values()), set(names)
    while open_:
        full = {s for s in open_ if 3 * sizes[s] <= left * weight[s] / sum(weight[x] for x in open_)}
        if not full:
            targets |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        targets |= {s: 3 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    assert {(r.source_size, round(r.target, 3)) for r in out} == {(sizes[s], round(targets[s], 3)) for s in names}
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    taken = collections.Counter()
    for r in out:
        taken[r.source_size] += r.taken
    longest = {s: max(r["size"] for r in out if r.source_size == sizes[s]) for s in names}
    assert all(abs(taken[sizes[s]] - targets[s]) <= longest[s] / 2 + 1 for s in names)
    assert mixing.mixed(none).count() == 0 and mixing.copies(none).count() == 0


def test_mix_is_range_sorted_and_repeatable(docs):
    one, two = mixing.mixed(docs).collect(), mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)
    at = [r.position for r in one if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_copies_hold_the_words_taken(odd):
    words = sum(len(WORD.findall(r.text or "")) for r in mixing.copies(odd).collect())
    assert words == sum(r.taken for r in mixing.mixed(odd).collect()) and mixing.copies(odd).columns == odd.columns


def test_mixing_of_one_row_that_is_a_third_of_the_table(spark):
    rows = [(1, "a b c", "s")] * 3000 + [(None, f"x {i}", "s") for i in range(3000)] + [(i, f"y {i} z {i}", "t") for i in range(2, 3000)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    assert out.count() == len(rows)
    taken = {r.target: r.taken for r in out.groupBy("target").agg(F.sum("taken").alias("taken")).collect()}
    assert all(abs(k - v) <= 2 for k, v in taken.items()) and out.where("taken > 3 * size").isEmpty()
    hot = [r["count"] for r in out.where("doc_id = 1").groupBy("taken").count().collect()]
    assert sum(hot) == 3000
    whole = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert whole.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())
    assert {r.text for r in whole.select("text").distinct().collect()} <= {r[1] for r in rows}


def test_copies_are_written_in_stretches(spark, monkeypatch):
    from tracewell.llm import numbering

    monkeypatch.setattr(numbering, "STRETCH", 10)
    df = spark.createDataFrame([(1,)] * 95 + [(k,) for k in range(2, 40)], "k long")
    rows = number_rows(df, ["k"]).collect()
    assert sorted(r.row for r in rows) == list(range(len(rows))) and len(rows) == df.count()


def test_schedule_inverts_its_integral(spark):
    shares = spark.range(101).select((F.col("id") / 100).alias("u"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    for r in shares.select("u", "k", mixing.training_time(F.col("u"), F.col("k")).alias("t")).collect():
        knots = mixing.SCHEDULES[r.k]
        x = np.linspace(0, 1, 20001)
        f = np.interp(x, [t for t, _ in knots], [v for _, v in knots])
        done = np.trapezoid(np.where(x <= r.t, f, 0), x) / np.trapezoid(f, x)
        assert abs(done - r.u) < 2e-3


# Secrets


def base(text):
    kinds = [(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 6), (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), (r"[0-9a-f]+", lambda m: len(m.group()) >= 24)]
    return sorted((m.start(), k, m.end()) for k, (rx, ok) in enumerate(kinds) for m in re.finditer(rx, text) if ok(m))


def test_base_spans_equal_the_patterns(docs, odd):
    for df in (docs, odd):
        out = secrets_scan.scan(df, secrets_scan.learn(df)).collect()
        texts = collections.defaultdict(set)
        for r in pairs_of(df):
            want = base(r.text or "")
            line = ",".join(f"{secrets_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
            texts[r.doc_id].add((*[sum(k == x for _, k, _ in want) for x in range(3)], hashlib.sha256(line.encode()).hexdigest()))
        assert len(out) == df.count() and all((r.n_assign, r.n_access, r.n_hex, r.base_sha256) in texts[r.doc_id] for r in out)


def test_patterns_on_hard_lines():
    draw = random.Random(8)
    parts = ["token", "=", ":", "secret", " ", '"', "abc", "abcdef", "é", "ſecret", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "Api_Key", "apikey"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        raw = text.encode()
        assert [(a, k, b) for a, b, k in secrets_scan.in_characters(raw, secrets_scan.base_spans(raw))] == base(text)


def test_markov_models_tell_random_from_ordinary(docs):
    model = secrets_scan.learn(docs)
    draw = random.Random(1)
    letters = secrets_scan.string.ascii_letters + secrets_scan.string.digits
    random_ones = ["".join(draw.choice(letters) for _ in range(32)) for _ in range(200)]
    joined = [f"path/of/words/{x[:20]}_old" for x in random_ones]
    words = ["invoice", "garden", "river", "update", "profile", "battery", "kitchen", "monthly", "engine", "market", "status", "window"]
    style = ("_".join, "-".join, "/".join, lambda w: w[0] + "".join(x.title() for x in w[1:]))
    ordinary = [draw.choice(style)([draw.choice(words) for _ in range(draw.randint(2, 5))]) for _ in range(400)]
    ordinary += ["getUserAccountInformation", "application_default_credentials", "https-www-example-com-index", "internationalization", "MAX_CONNECTION_TIMEOUT", "the_quick_brown_fox_jumps"]
    found = lambda xs: sum(bool(secrets_scan.find_spans(f"see {x} here", model)) for x in xs)
    assert found(random_ones) >= 198 and found(joined) >= 190 and found(ordinary) <= 2
    beside = "0123456789abcdef01234567" + random_ones[0]
    kinds = [k for _, _, k in secrets_scan.find_spans(beside, model)]
    assert 2 in kinds and 3 in kinds


def test_markov_models_on_held_out_runs(spark, sf):
    larger = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    found = secrets_scan.evaluate(larger, secrets_scan.learn(larger))
    assert found["precision"] > 0.9 and found["recall"] > 0.9 and found["secrets"] > 0 and found["runs"] > 10_000


def test_ordinary_identifiers_of_hard_kinds_and_random_strings(spark, sf):
    """Measured on samples of a seed that nothing is learned from."""
    model = secrets_scan.learn(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"))
    got = secrets_scan.measured(model, 99, 400)
    kinds = ("uuid", "charsets", "part_number", "acronym", "consonants", "url_id", "address", "protein", "time")
    assert {k: got[k] for k in kinds if got[k] > 0.02} == {}
    assert got["base62_32"] > 0.99 and got["base62_20"] > 0.95 and got["base62_16"] > 0.85 and got["base64url_20"] > 0.95 and got["lower36_20"] > 0.9
    listed = ["3f2b8c1e-9a4d-4e77-8b21-0c5d6e7f8a9b", "ISO-8859-1/UTF-16LE/CP1252", "XJ-9000-QK-47B-REV3", "GHCNDXWQZ", "kqxzvwjp", "https://v.example/watch?v=dQw4w9WgXcQ", "0x7ffee4c3b8a0", "MKTAYIAKQRQISFVKSHFSRQLEERLG"]
    assert [x for x in listed if secrets_scan.find_spans(f"a {x} b", model)] == []


def test_texts_that_are_measured_on_are_not_learned_from(docs):
    learned = secrets_scan.learn(docs)
    measured = docs.select("text", secrets_scan._rank().alias("rank")).where(secrets_scan._part() == secrets_scan.MEASURED)
    others = docs.join(measured.select("text").distinct(), "text", "left_anti")
    same = secrets_scan._fitted(secrets_scan._sampled(others, secrets_scan.SAMPLE))
    assert measured.count() > 0 and np.array_equal(learned.ratios, same.ratios) and learned.least == same.least


def test_models_count_every_text_once(spark):
    """More texts than were once sampled, with copies, against a plain count over all of them."""
    texts = [f"line {n} token=q{n * 7919 % 10007}Zk{n}x and someWord{n}" for n in range(9000)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts + texts[:500])] + [(9999, None)], "doc_id long, text string").repartition(7)
    part = {r.text: r.part for r in rows.where("text IS NOT NULL").select("text", secrets_scan._rank().alias("rank")).withColumn("part", secrets_scan._part()).collect()}
    counted = sum(secrets_scan._counted(t.encode()) for t in texts if part[t] not in (secrets_scan.FITTED, secrets_scan.MEASURED))
    assert np.array_equal(secrets_scan.learn(rows).ratios, secrets_scan._models(counted.astype(float)))


def test_best_segments_equal_brute_force():
    draw = np.random.default_rng(5)
    ratios = draw.normal(0, 3, (secrets_scan.START + 1, secrets_scan.START))
    for _ in range(60):
        codes = np.where(draw.random(60) < 0.1, 255, draw.integers(0, secrets_scan.START, 60)).astype(np.uint8)
        starts, ends, scores = secrets_scan.best_segments(codes, ratios)
        for (a, b), start, end, score in zip(zip(*secrets_scan.runs_of(codes)), starts, ends, scores):
            steps = [ratios[secrets_scan.START if i == a else codes[i - 1], codes[i]] for i in range(a, b)]
            best = max((sum(steps[i:j]), i, j) for i in range(len(steps)) for j in range(i, len(steps) + 1))
            if sum(max(x, 0) for x in steps) >= secrets_scan.LEAST_SCORE:
                assert abs(score - best[0]) < 1e-9 and abs(sum(steps[start - a : end - a]) - best[0]) < 1e-9
            else:
                assert score == 0


def test_secrets_are_replaced(spark, odd, none):
    out = {r.doc_id: r for r in secrets_scan.without_secrets(odd).collect()}
    assert out[15].text == "[secret]" + '"' and out[15].n_chars == len(out[15].text) and out[0].text is None
    assert secrets_scan.without_secrets(odd).columns == odd.columns and secrets_scan.without_secrets(none).count() == 0


# Near duplicates


def brute_groups(rows, size, percent):
    sets = collections.defaultdict(set)
    for i, text in rows:
        w = WORD.findall(lower(text or ""))
        sets[i].add(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label, sets


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(docs, odd, size, percent):
    for df in (docs, odd):
        label, sets = brute_groups([(r.doc_id, r.text) for r in pairs_of(df)], size, percent)
        for r in minhash.near_duplicates(df, size, percent).collect():
            assert r.component_id == label.get(r.doc_id) and r.kept == (r.doc_id == label.get(r.doc_id) or r.doc_id is None)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_large_group_of_near_copies(spark):
    """More members than a small bucket, with some that only a member other than the hub links."""
    draw = random.Random(6)
    first = [f"w{draw.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(first)
        for _ in range(draw.choice((0, 1, 2, 4, 6, 8))):
            words[draw.randrange(len(words))] = f"n{draw.randint(0, 99999)}"
        rows.append((i, " ".join(words)))
    label, _ = brute_groups(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == label and len(set(label.values())) > 1


def test_near_duplicates_empty_and_columns(odd, none):
    assert minhash.near_duplicates(none).count() == 0
    out = minhash.without_near_duplicates(odd)
    assert out.columns == odd.columns and {5, 6, 7} & {r.doc_id for r in out.collect()} == {5}


def test_hubs_and_heavy_nodes_are_spread(spark, monkeypatch):
    from tracewell.llm import components

    monkeypatch.setattr(minhash, "HUB_MEMBERS", 20)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(components, "NODE_LINKS", 10)
    test_large_group_of_near_copies(spark)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(60, 70)]
    out = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {out[i] for i in range(60)} == {0} and {out[i] for i in range(60, 71)} == {60}


def template_pages(n, words=60, own=8):
    """Short pages of one template: any two share about three quarters of their shingles, and none links."""
    frame = [f"frame{i}" for i in range(words - own)]
    return [(i, " ".join(frame[:20] + [f"p{i}w{k}" for k in range(own)] + frame[20:])) for i in range(n)]


def test_prefix_keys_bring_all_similar_sets_together(spark):
    draw = np.random.default_rng(3)
    common = draw.integers(0, 2**62, 300)
    sets = [np.unique(np.concatenate((draw.choice(common, int(draw.integers(1, 120))), draw.integers(0, 2**62, int(draw.integers(0, 6)))))) for _ in range(120)]
    for base in list(sets[:60]):
        keep = draw.random(len(base)) < draw.choice([0.8, 0.9, 0.95, 1.0])
        sets.append(np.unique(np.concatenate((base[keep], draw.integers(0, 2**62, int(draw.integers(0, 4)))))))
    sets = [x for x in sets if len(x)]
    for percent in (85, 80, 50):
        rest = spark.createDataFrame([(i, True, i, x.tolist()) for i, x in enumerate(sets)], "node long, far boolean, own long, hashes array<long>").repartition(3)
        keys = collections.defaultdict(set)
        for r in minhash.prefix_keys(rest, minhash.rarity(rest), percent).collect():
            keys[r.node].add(r.key)
        similar = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if (n := len(np.intersect1d(x, y))) * 100 >= percent * (len(x) + len(y) - n)]
        assert len(similar) > 20 and all(keys[i] & keys[j] for i, j in similar)
        placed = rest.selectExpr("0L AS band", "node", "CAST(size(hashes) AS bigint) AS n", "own", "far")
        got = {frozenset(r) for r in minhash.more_links(placed, rest.select("node", "hashes"), percent).collect()}
        assert {frozenset(p) for p in connected_pairs(similar)} == {frozenset(p) for p in connected_pairs([tuple(x) for x in got])}


def connected_pairs(links):
    """Each node with the smallest one it is connected with."""
    home = {}

    def root(x):
        while home.get(x, x) != x:
            x = home[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        home[b] = a
    return {(x, root(x)) for pair in links for x in pair}


def test_pages_of_one_template_meet_under_few_keys(spark):
    pages = spark.createDataFrame(template_pages(1500), "node long, text string")
    rest = minhash.shingle_sets(pages, 3).selectExpr("node", "TRUE AS far", "node AS own", "hashes")
    keys = minhash.prefix_keys(rest, minhash.rarity(rest), 85)
    assert keys.groupBy("key").count().where("count > 1").isEmpty() and keys.count() < 1500 * 200


@pytest.mark.parametrize("direct", [0, minhash.DIRECT])
def test_near_copies_among_pages_of_a_template(spark, monkeypatch, direct):
    monkeypatch.setattr(minhash, "DIRECT", direct)
    pages = template_pages(400)
    copies = [(1000 + i, t.replace("frame50", "other")) for i, t in pages[:100]]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(pages + copies, "doc_id long, text string"), 3, 85).collect()}
    assert out == {i: i % 1000 if i >= 1000 else i for i in out}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    out = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(out[i] == 0 for i in range(41)) and out[103] == out[101] == out[100] == 100


# Quality classifier


def test_quality_held_out(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_model.score(docs, quality_model.fit(docs, labels)).join(labels, "doc_id").collect()
    good, bad = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in out)


def test_quality_rows_equal_a_plain_count():
    data, offsets = np.frombuffer(b"a a bbb C9!! a", np.uint8), np.array([0, 14])
    (at, values), = quality_model.rows_of(data, offsets)
    assert len(at) == len(set(at)) and at[-1] == (1 << quality_model.BITS) - 1 and values[-1] == 1
    assert abs((values[:-1] ** 2).sum() - 1) < 1e-9


def test_quality_learns_from_a_repeated_row_once(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels, "doc_id").where(~quality_model.held_out()).select("doc_id", "text")
    many = docs.select("doc_id", "text").union(known.limit(1).crossJoin(spark.range(20_000)).drop("id"))
    assert (quality_model.fit(many, labels) == quality_model.fit(docs, labels)).all()


def test_quality_scores_equal_a_plain_sum(spark, docs):
    weights = np.random.default_rng(4).normal(size=1 << quality_model.BITS)
    out = {r.doc_id: r.score for r in quality_model.score(docs, weights).collect()}
    for r in docs.limit(20).collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        ((at, values),) = quality_model.rows_of(raw, np.array([0, len(raw)]))
        z = sum(float(np.float32(weights[a])) * v for a, v in zip(at, values))
        assert abs(out[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-6


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (9, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.score(odd, quality_model.fit(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    blank = quality_model.fit(none, labels.limit(0))
    assert {r.score for r in quality_model.score(odd, blank).collect()} == {0.5} and quality_model.score(none, blank).count() == 0


# Audio


def test_tables_follow_the_standard():
    assert [audio.MULAW[x] for x in (0x00, 0x80, 0xFF, 0x7F, 0x0F)] == [-32124, 32124, 0, 0, -16764]
    assert [audio.ALAW[x] for x in (0xD5, 0x55, 0x2A, 0xAA)] == [8, -8, -32256, 32256]


def test_adpcm_equals_a_scalar_decoder():
    blocks = np.random.default_rng(3).integers(0, 256, (20, 64), dtype=np.uint8)
    out = audio.decode_adpcm(blocks)
    for block, got in zip(blocks, out):
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(audio.STEPS[index])
                size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - size if code & 8 else value + size))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(value)
        assert got.tolist() == want


def test_audio_round_trip(odd, none, monkeypatch):
    out = audio.digests(audio.store(odd)).collect()
    want = collections.Counter()
    for r in pairs_of(odd):
        raw = (r.text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), hashlib.sha256(audio.wav_file(padded)).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in out) == want
    assert audio.digests(audio.store(none)).count() == 0


def test_audio_stores_plain_resampled_samples(odd):
    """The pcm column holds 16-bit samples at twice the rate, nothing that has to be decoded first."""
    rows = audio.store(odd.where("length(text) < 300 OR text IS NULL")).collect()
    assert rows
    for r in rows:
        samples = [int(x) for x in audio.MULAW[list(audio.wav_payload(bytes(r.media)))]]
        assert np.frombuffer(r.pcm, "<i2").tolist() == plain_pcm(samples)


def plain_pcm(samples):
    """Twice the rate by the filter's definition, in whole numbers."""
    out, last = [], len(samples) - 1
    for i, x in enumerate(samples):
        total = sum(int(h) * (samples[max(i - k, 0)] + samples[min(i + 1 + k, last)]) for k, h in enumerate(audio.FILTER))
        out += [x, max(-32768, min(32767, (total + (1 << 14)) >> 15))]
    return out


def plain_feature(payload):
    rows = [("mulaw", audio.MULAW[list(payload)]), ("alaw", audio.ALAW[list(payload)]), ("adpcm", audio.decode_adpcm(np.frombuffer(payload, np.uint8).reshape(-1, 64)).ravel())]
    out = []
    for name, samples in rows:
        pcm = np.array(plain_pcm([int(x) for x in samples]), "<i2")
        out.append(f"{name}={len(pcm)},{int(np.abs(pcm.astype(int)).sum()) // len(pcm)},{zlib.crc32(pcm.tobytes()):08x}")
    return ";".join(out)


def test_features_equal_a_plain_version_in_any_parts(odd, monkeypatch):
    payloads = [bytes(np.random.default_rng(k).integers(0, 256, 64 * n, dtype=np.uint8)) for k, n in enumerate((1, 40, 7))]
    want = [plain_feature(p) for p in payloads]
    for size in (audio.PART_BYTES, 128, 64):
        monkeypatch.setattr(audio, "PART_BYTES", size)
        assert audio.features(payloads, audio.pcm_of(payloads)) == want
    texts = {audio.padded((r.text or "").encode()) for r in pairs_of(odd.where("length(text) < 300 OR text IS NULL"))}
    features = {r.feature for r in audio.digests(audio.store(odd)).collect()}
    assert {plain_feature(t) for t in texts} <= features


def test_loud_samples_in_the_signs_of_the_filter_are_clipped():
    signs = np.sign(np.concatenate((audio.FILTER[::-1], audio.FILTER)))
    wide = np.tile(signs * 32256, 4).astype(np.int32)
    got = audio.between(wide, np.array([len(wide)]))
    padded = np.concatenate(([wide[0]] * audio.TAPS, wide, [wide[-1]] * audio.TAPS)).astype(object)
    for i in range(len(wide)):
        total = (1 << 14) + sum(int(h) * (int(padded[i + audio.TAPS - k]) + int(padded[i + audio.TAPS + 1 + k])) for k, h in enumerate(audio.FILTER))
        assert got[i] == min(max(total >> 15, -32768), 32767)
    assert got.max() == 32767


def test_the_filter_keeps_a_tone():
    t = np.arange(400)
    tone = lambda t: 20000 * np.sin(0.3 * t)
    between = audio.between(np.rint(tone(t)).astype(np.int32), np.array([400]))
    assert np.abs(between[20:-20] - tone(t[20:-20] + 0.5)).max() < 20


@pytest.mark.parametrize("n", [0, 1, 2, 9, 8191, 8192, 20001])
def test_stored_pcm_is_any_pcm(n):
    noise = np.random.default_rng(n).integers(-32768, 32768, n).astype("<i2")
    assert (audio.unpack_pcm(audio.pack_pcm(noise)) == noise).all()
    codes = audio.MULAW[np.random.default_rng(n).integers(0, 256, n)].astype(np.int32)
    pcm = audio.resample(codes, np.array([n])) if n else np.zeros(0, "<i2")
    packed = audio.pack_pcm(pcm)
    assert (audio.unpack_pcm(packed) == pcm).all() and len(packed) <= n + 10 + n // 4096


# Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p) == list(range(n)) and (sharding.permute(p, n, inverse=True) == np.arange(n)).all()
    shard, slot = sharding.place_of(n - 1, n)
    assert sharding.row_at(shard, slot, n) == n - 1


def test_sharding(docs, odd, none):
    for df in (docs, odd):
        out = sharding.shard_documents(df).collect()
        assert sorted(r.row for r in out) == list(range(df.count()))
        slots = collections.defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in pairs_of(df))
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert sharding.shard_documents(none).count() == 0
    assert sorted(map(tuple, sharding.shard_documents(docs).collect())) == sorted(map(tuple, sharding.shard_documents(docs.repartition(5)).collect()))


def test_numbers_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("k"))
    got = collections.defaultdict(list)
    for r in number_rows(df, ["k"], within="g").collect():
        got[r.g].append(r.row)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 500


# Regression


def test_ftrl_equals_a_plain_version():
    """Each coordinate by itself, in the words of the method: per-coordinate rates, L1 and L2 in the closed form of the weight."""
    from tracewell.llm.ftrl import Ftrl

    draw, alpha, beta, l1, l2 = np.random.default_rng(6), 0.5, 1.0, 1.5, 0.3
    for classes, binary in ((1, True), (3, False)):
        model = Ftrl(20, classes, alpha, beta, l1, l2)
        z, n = collections.defaultdict(float), collections.defaultdict(float)

        def weight(i, c):
            if abs(z[i, c]) <= l1:
                return 0.0
            return -(z[i, c] - math.copysign(l1, z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

        for _ in range(150):
            at = draw.choice(20, int(draw.integers(1, 6)), replace=False)
            x = draw.normal(0, 1, len(at))
            label = int(draw.integers(0, 2 if binary else classes))
            target = np.array([float(label)]) if binary else np.eye(classes)[label]
            model.learn(at, x, target, binary)
            logits = [sum(v * weight(i, c) for i, v in zip(at, x)) for c in range(classes)]
            guess = [1 / (1 + math.exp(-logits[0]))] if binary else [math.exp(q) / sum(map(math.exp, logits)) for q in logits]
            steps = {}
            for i, v in zip(at, x):
                for c in range(classes):
                    g = v * (guess[c] - target[c])
                    steps[i, c] = (g, (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha, weight(i, c))
            for key, (g, rate, w) in steps.items():
                z[key] += g - rate * w
                n[key] += g * g
        want = np.array([[weight(i, c) for c in range(classes)] for i in range(20)])
        assert np.allclose(model.weights(), want) and (want == 0).any() and (want != 0).any()


# Quality rules


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_rules_equal_brute_force(docs, odd, none):
    for df in (docs, odd):
        want = collections.Counter((r.doc_id, *brute_rules(r.text)) for r in pairs_of(df))
        out = quality_rules.judged(df).collect()
        assert collections.Counter((r._id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
        assert not any(r.kept and r.base_failed for r in out)
    assert quality_rules.judged(none).count() == 0 and quality_rules.kept_documents(odd).columns == odd.columns


def test_rules_agree_with_labels(spark, sf):
    larger = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out = quality_rules.judged(spark.read.parquet(f"{larger}/documents.parquet")).join(labels, F.col("_id") == F.col("doc_id")).collect()
    good = [r for r in out if r.label and not r.base_failed]
    bad = [r for r in out if not r.label]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.1


def brute_estimate(rows, rules, rounds):
    """rows of votes, to the prior and P(vote | class) by class, rule and vote."""
    weight, start = quality_rules.PRIOR_DOCUMENTS, quality_rules.PRIOR_VOTES
    prior, p = quality_rules.PRIOR_GOOD, [[list(start[c]) for _ in range(rules)] for c in (0, 1)]
    counts = collections.Counter(map(tuple, rows))
    for _ in range(rounds):
        seen = [[[weight * x for x in start[c]] for _ in range(rules)] for c in (0, 1)]
        good_total = weight * quality_rules.PRIOR_GOOD
        for row, n in counts.items():
            good, bad = prior, 1 - prior
            for k, v in enumerate(row):
                good, bad = good * p[1][k][v], bad * p[0][k][v]
            share = good / (good + bad)
            good_total += n * share
            for k, v in enumerate(row):
                seen[1][k][v] += n * share
                seen[0][k][v] += n * (1 - share)
        prior = good_total / (len(rows) + weight)
        p = [[[x / sum(r) for x in r] for r in c] for c in seen]
    return prior, p


def test_estimates_equal_brute_force(spark):
    draw = np.random.default_rng(2)
    good = draw.random(3000) < 0.7
    rows = [[int(draw.choice(3, p=((0.5, 0.2, 0.3), (0.05, 0.6, 0.35))[int(g)])) for _ in range(5)] for g in good]
    names = list("abcde")
    prior, table = quality_rules.fit(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), names, 15)
    want, p = brute_estimate(rows, 5, 15)
    assert abs(prior - want) < 1e-9 and abs(prior - 0.7) < 0.05
    for k, n in enumerate(names):
        assert np.allclose([p[0][k], p[1][k]], table[n], atol=1e-9)
    some = [[0, 1, 2, 1, 0], [1, 1, 1, 1, 1], [0, 0, 2, 0, 0]]
    got = spark.createDataFrame(some, ", ".join(f"{n} int" for n in names)).select(quality_rules._posterior(names, prior, table).alias("p")).collect()
    for row, r in zip(some, got):
        good, bad = math.prod([want] + [p[1][k][v] for k, v in enumerate(row)]), math.prod([1 - want] + [p[0][k][v] for k, v in enumerate(row)])
        assert abs(r.p - good / (good + bad)) < 1e-9


def test_a_harmless_trait_does_not_drop_documents(spark, docs):
    """A third of clean documents trip one rule: they stay, and documents that trip several go."""
    clean = [r.text for r in docs.orderBy("doc_id").collect() if not brute_rules(r.text)[-1] and re.fullmatch(r"[\w\s.,]+", r.text)]
    rows = [(i, t.upper() if i % 3 == 0 else t) for i, t in enumerate(clean * 3)]
    junk = [(100_000 + i, " ".join(w.upper() + "##!!" for w in t.split()[:200])) for i, t in enumerate(clean[:60])]
    out = {r._id: r for r in quality_rules.judged(spark.createDataFrame(rows + junk, "doc_id long, text string")).collect()}
    tripped = [out[i] for i, _ in rows if out[i].vote_capitals == 0 and not out[i].base_failed]
    assert len(tripped) > len(rows) / 4 and np.mean([r.kept for r in tripped]) > 0.98
    assert not any(out[i].kept for i, _ in junk if not out[i].base_failed)


def test_the_verdict_is_not_all_must_pass(spark, sf):
    larger = sf.replace("0.001", "0.1")
    out = quality_rules.judged(spark.read.parquet(f"{larger}/documents.parquet"))
    names = [c for c in out.columns if c.startswith("vote_")]
    any_bad = F.least(*names) == 0
    assert not out.where(any_bad & F.col("kept")).isEmpty() and not out.where(~any_bad & ~F.col("base_failed") & ~F.col("kept")).isEmpty()


# Token files


def test_token_files_round_trip(spark, docs, odd, none, tmp_path):
    e = encoder(token_files.default_tokenizer())
    for k, df in enumerate((docs, odd)):
        folder = f"file://{tmp_path}/{k}"
        token_files.write_token_files(df, token_files.default_tokenizer(), folder, file_tokens=20_000)
        out = token_files.read_token_files(spark, folder).orderBy("start").collect()
        assert spark.read.parquet(f"{folder}/index").count() > 1 or k
        ids = [r.doc_id for r in out]
        assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
        want = collections.Counter()
        for r in pairs_of(df):
            own = np.array(e.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], np.uint32)
            want[r.doc_id, len(own), crc32_of(own), int((own == 0).sum())] += 1
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.n_end_ids) for r in out) == want
        upto = 0
        for r in out:
            assert r.start == upto
            upto += r.n_tokens
            assert r.end_at == upto - 1
    token_files.write_token_files(none, token_files.default_tokenizer(), f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("top, n", [(50257, 3000), (1, 300), (2, 700_000), (70_000, 600_000)])
def test_wavelet_matrix(top, n):
    import pyarrow as pa

    ids = np.random.default_rng(1).integers(0, top, n).astype(np.uint32)
    ids[100:200] = 7 % top
    raw = token_files.pack(ids, np.array([10, n - 10]), pa.array([None, 5], pa.int64()))
    m = token_files.WaveletMatrix(raw)
    at = np.arange(0, n, max(n // 200, 1))
    assert (m.access(at) == ids[at]).all() and m.doc_ids.to_pylist() == [None, 5]
    assert n < 100_000 or len(m.blocks) <= m.planes * m.per_plane
    for token in {7 % top, int(ids[n // 2])}:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where) and (m.rank(token, at) == np.searchsorted(where, at)).all()
        some = np.arange(0, len(where), max(len(where) // 50, 1))
        assert (m.select(token, some) == where[some]).all()
    assert (m.all_ids() == ids).all()
    assert m.count(1 << 20) == 0 and m.document_of(9) == 0 and m.document_of(10) == 1
    for broken in (raw[:-9] + b"123456789", raw[:60] + b"12345" + raw[65:], b"x" + raw[1:]):
        with pytest.raises(ValueError):
            token_files.WaveletMatrix(broken).all_ids()


def test_a_lookup_opens_few_blocks():
    import pyarrow as pa

    ids = np.random.default_rng(1).integers(0, 50257, 1_500_000).astype(np.uint32)
    raw = token_files.pack(ids, np.array([len(ids)]), pa.array([1]))
    m = token_files.WaveletMatrix(raw)
    assert m.access([1_000_000])[0] == ids[1_000_000] and len(m.blocks) <= m.planes < m.planes * m.per_plane
    same = token_files.pack(np.full(1_500_000, 9, np.uint32), np.array([len(ids)]), pa.array([1]))
    assert len(same) < len(raw) / 50


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    import json

    import pyarrow as pa

    stated = json.load(open(token_files.default_tokenizer()))
    stated["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(stated))
    e = encoder(str(tmp_path / "t.json"))
    assert not e.in_pieces and encoder(token_files.default_tokenizer()).in_pieces
    texts = ["one two", "x.y", ""]
    ((_, _, ids, first),) = e.texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_pieces_encode_like_whole_texts():
    import pyarrow as pa

    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "é", "É", "×", "ß", "日本", "　", " ", "\xa0", "\x85", "\x1c", "'s", "'ll", "12", "!!", "<|endoftext|>", "Word", "😀", "​", "\x00", "-", "x.y", "don't"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(4000)] + ["", None]
    e = encoder(token_files.default_tokenizer())
    for k in range(0, len(texts), 40):
        got = [ids[f[i] : f[i + 1]].tolist() for a, b, ids, f in e.texts(pa.array(texts[k : k + 40])) for i in range(b - a)]
        assert got == [e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts[k : k + 40]]


# All


def test_every_query_runs_on_a_whole_table(spark, sf, docs):
    for name in QUERIES:
        if name not in ("op2_best_fit_packing", "op11_vector_codes", "op12_source_audit"):  # of which rows are no documents
            assert QUERIES[name](spark, sf).count() == docs.count(), name
    assert QUERIES["op2_best_fit_packing"](spark, sf).select("doc_id").distinct().count() == docs.count()


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in pairs_of(docs)}
    kept = stages["quality_rules"](spark, docs, sf).cache()
    assert kept.columns == docs.columns and not any(brute_rules(r.text)[-1] for r in pairs_of(kept))
    single = stages["near_dedup"](spark, kept, sf).cache()
    label, _ = brute_groups([(r.doc_id, r.text) for r in pairs_of(kept)], 5, 80)
    assert {r.doc_id for r in single.collect()} == set(label.values())
    masked = stages["secret_scans"](spark, single, sf).cache()
    assert masked.count() == single.count() and not any(base(r.text) for r in pairs_of(masked))
    mix = stages["mixing"](spark, masked, sf).cache()
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= set(texts)
    check_packing(stages["packing"](spark, mix, sf).collect(), [(r.doc_id, r.text) for r in pairs_of(mix)])


def test_stages_take_any_column_name_and_keep_one_of_equal_rows(spark):
    import corpus_pipeline

    words = [f"{a}{b}" for a in ("al", "ber", "con", "der", "en", "fol", "gar", "hun") for b in ("a", "ine", "to", "um", "ert", "ost")]
    text = " ".join(words).capitalize() + "."
    rows = [(1, text, "s", "a", "b"), (1, text, "s", "a", "b"), (2, text + " More.", "s", "a", "b"), (3, "Another document that has nothing in common with the first one, but for some of its very short and plain words.", "s", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string, `c``d e` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "source", "a.b", "c`d e"], name
        if name == "near_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == [1, 3]
    assert {r.doc_id for r in docs.collect()} <= {1, 3}
    assert minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string, a string, b string")).count() == 2


def test_pipeline_on_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    left = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    for name, df in (("odd", odd), ("none", none)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        before = left()
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert len(left() - before) == 1
        rows = out.collect()
        assert bool(rows) == (name == "odd") and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
        assert all(r.length > 0 for r in rows)
