"""Windows, block-wise best paths and the whole model stage against plain versions."""

import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.operators import blocks as B
from tracewell.operators import merge, model

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELS = ["O", *[f"{t}-{c}" for c in ("private_person", "private_date") for t in "BIES"]]


def words():
    return lambda texts: [[(sum(map(ord, m.group())) % 1000 + (1000 if m.group()[0].isupper() else 0), m.start(), m.end()) for m in re.finditer(r"\S+|\A\n\Z", t)] for t in texts]


def reach(ids):
    """Logits from an id and its two neighbours on either side."""
    padded = np.concatenate(([7, 7], ids, [7, 7])).astype(np.int64)
    around = sum(padded[i : i + len(ids)] * (i + 3) for i in range(5))
    return np.stack([np.sin(around * (k + 1) * 0.37) * 3 for k in range(len(LABELS))], axis=1)


def make_reach():
    return reach


def names():
    """Runs of capitalised words are people."""

    def score(ids):
        big = np.concatenate(([False], np.asarray(ids) >= 1000, [False]))
        out = np.zeros((len(ids), len(LABELS)))
        for i in range(len(ids)):
            before, mine, after = big[i : i + 3]
            out[i, 0 if not mine else LABELS.index(("I" if after else "E") + "-private_person") if before else LABELS.index(("B" if after else "S") + "-private_person")] = 6.0
        return out

    return score


@pytest.mark.parametrize("size,overlap", [(1536, 128), (16, 4), (9, 2)])
def test_windows_equal_one_pass(spark, size, overlap):
    draw = random.Random(size)
    texts = {b: [" ".join(draw.choice(["ab", "Cd", "e", "Fgh"]) * draw.randint(1, 3) for _ in range(draw.choice([0, 1, 3, 40]))) for _ in range(n)] for b, n in (("long", 400), ("short", 1), (None, 30))}
    rows, whole = [], {}
    for bundle, lines in texts.items():
        at = 0
        for line in lines:
            rows.append((bundle, at, line))
            at += len(line) + 1
        whole[bundle] = "\n".join(lines)
    placed = spark.createDataFrame(rows, "bundle string, start long, text string").repartition(5)
    got = model.score_windows(model.tokens_of(placed, words), make_reach, size, overlap).collect()
    for bundle, text in whole.items():
        want = words()([text])[0]
        mine = sorted((r for r in got if r.bundle == bundle), key=lambda r: r.block)
        assert [(a, b) for r in mine for a, b in zip(r.starts, r.ends)] == [(a, b) for _, a, b in want]
        logits = np.array([x for r in mine for x in r.logits]).reshape(-1, len(LABELS))
        assert np.allclose(logits, reach(np.array([i for i, _, _ in want])), atol=1e-5)
    assert len([r for r in got if r.bundle == "long"]) > (1 if size > 1000 else 20)


def plain_spans(logits, labels):
    logp = B.log_probabilities(logits)
    path, out = model.best_path(logp, labels), []
    for i, k in enumerate(path):
        if labels[k][0] in "BS":
            first = i
        if labels[k][0] in "ES":
            out.append((labels[k][2:], first, i + 1, np.exp(logp[range(first, i + 1), path[first : i + 1]]).mean()))
    return out


def long_spans(n, draw):
    """Logits that favour spans of hundreds of tokens, so that they cross whole blocks."""
    out = draw.normal(0, 1, (n, len(LABELS)))
    at = 0
    while at < n:
        length = int(draw.integers(1, 200))
        kind = draw.integers(3)
        if kind:
            first = 1 + 4 * (kind - 1)
            out[at : at + length, first + 1] += 8
            out[at, first] += 20
            out[min(at + length, n) - 1, first + 2] += 20
        else:
            out[at : at + length, 0] += 8
        at += length
    return out


@pytest.mark.parametrize("size,fan", [(1, 2), (7, 2), (64, 3), (10_000, 64)])
def test_best_path_in_blocks_equals_one_pass(spark, monkeypatch, size, fan):
    monkeypatch.setattr(B, "FAN", fan)
    draw = np.random.default_rng(size)
    documents = {1: draw.normal(0, 2, (300 if size > 1 else 40, len(LABELS))), 2: draw.normal(0, 2, (1, len(LABELS))), 3: long_spans(900 if size > 1 else 60, draw), None: draw.normal(0, 2, (65, len(LABELS)))}
    rows = [(d, pos, pos, pos + 1, x.tolist()) for d, logits in documents.items() for pos, x in enumerate(logits)]
    scores = spark.createDataFrame(rows, "doc_id long, pos int, start int, end int, logits array<double>").repartition(3)
    got = model.decode_spans(scores, LABELS, size).collect()
    for d, logits in documents.items():
        mine = sorted((r.category, r.start, r.end, round(r.score, 6)) for r in got if r.doc_id == d)
        assert mine == sorted((c, a, b, round(float(p), 6)) for c, a, b, p in plain_spans(logits, LABELS))
    assert any(r.end - r.start > 100 for r in got) or size == 1


def test_max_plus_products_are_paths():
    draw = np.random.default_rng(1)
    logp, move = B.log_probabilities(draw.normal(0, 1, (30, 9))), B.moves(LABELS)
    a, b = B.transfer(logp[:13], move), B.transfer(logp[13:], move)
    assert np.allclose((a[:, :, None] + b).max(axis=1)[0], B.transfer(logp, move)[0])


LINES = "bundle string, path string, page int, line int, kind string, text string"


def stage_rows():
    rows = [("b1", f"src/{i}.py", None, 3, "text", "# author Ann Bell wrote this") for i in range(4)]
    rows += [("b1", "notes.txt", None, i, "text", f"plain line {i}") for i in range(1, 30)]
    rows += [("b1", "notes.txt", None, 30, "text", "call Bob"), ("b1", "notes.txt", None, 31, "text", "Smith tomorrow"), ("b1", "x/John Doe.doc", None, None, "filename", "John Doe.doc"), ("b1", "x/a.py", None, None, "filename", "a.py")]
    rows += [("b1", "pic.png", None, 1, "ocr", "Carl was here"), ("b1", "pic.png", None, 1, "metadata", "photo of Dora"), (None, "other.txt", None, 1, "text", "Eve"), ("b1", "src/z.py", None, 1, "text", "no such thing = 1"), ("b1", "long.txt", None, 1, "text", "Zed " * 600)]
    return rows


def test_the_stage_finds_names_at_all_their_places(spark):
    stage = model.model_stage(spark.createDataFrame(stage_rows(), LINES).repartition(4), words, names, LABELS, size=16, overlap=4)
    got = {(r.bundle, r.value, r.path, r.line, r.kind) for r in stage.matches.collect()}
    want = {("b1", "Ann Bell", f"src/{i}.py", 3, "text") for i in range(4)}
    # A name over two lines belongs to the first of them.
    want |= {("b1", "Bob Smith", "notes.txt", 30, "text"), ("b1", "John Doe.doc", "x/John Doe.doc", None, "filename"), ("b1", "Carl", "pic.png", 1, "ocr"), ("b1", "Dora", "pic.png", 1, "metadata"), (None, "Eve", "other.txt", 1, "text")}
    assert got == want
    one = stage.matches.where("path = 'notes.txt'").first()
    assert one.context == "call Bob" and one.category == "private_person" and one.score > P.MIN_SPAN_SCORE
    assert stage.used.where("admitted").count() == stage.used.count() == 29 + 2 + 1 + 1 + 1 + 1 + 1


def test_the_stage_keeps_its_budget(spark):
    lines = spark.createDataFrame(stage_rows(), LINES)
    stage = model.model_stage(lines, words, names, LABELS, budget=30, size=16, overlap=4)
    used = {r[0]: r[1] for r in stage.used.where("admitted").selectExpr("bundle", "tokens + 1 AS c").groupBy("bundle").sum("c").collect()}
    assert used["b1"] <= 30 and used[None] == 2
    over = {r.bundle: r for r in model.not_model_scanned(stage).collect()}
    assert set(over) == {"b1"} and over["b1"].not_model_scanned == ["notes.txt", "src/0.py", "src/1.py", "src/2.py", "src/3.py"]
    # File names, metadata and pictures come before documents.
    assert {"John Doe.doc", "Dora", "Carl"} <= {r.value for r in stage.matches.collect()}


def test_an_empty_stage(spark):
    stage = model.model_stage(spark.createDataFrame([], LINES), words, names, LABELS)
    assert stage.matches.isEmpty() and stage.used.isEmpty()


def test_spans_and_lines_over_many_buckets(spark):
    draw = random.Random(8)
    lines = [("b", i, "x" * draw.choice([0, 1, 5, 90])) for i in range(80)]
    starts, at = [], 0
    for _, i, t in lines:
        starts.append((at, at + len(t) + 1, i, t))
        at += len(t) + 1
    spans = [("b", a, a + draw.choice([1, 3, 70])) for a in draw.sample(range(at - 80), 60)]
    frame = spark.createDataFrame(lines, "bundle string, seq long, text string")
    got = model.offsets_to_lines(spark.createDataFrame(spans, "bundle string, start long, end long"), frame, bucket=8).collect()
    want = [(a, b, i, a - s, min(len(t), b - s)) for _, a, b in spans for s, n, i, t in starts if s <= a < n]
    assert sorted((r.start, r.end, r.seq, r.line_start, r.line_end) for r in got) == sorted(want)
    placed = model.line_starts(frame).join(frame, ["bundle", "seq"])
    text = "\n".join(t for _, _, t in lines)
    for r in model.span_values(spark.createDataFrame(spans, "bundle string, start long, end long"), placed, bucket=8).collect():
        assert r.value == text[r.start : r.end] or r.value == text[r.start : r.end].removesuffix("\n")


def test_a_text_that_stands_everywhere_is_dealt_out(spark):
    rows = [("hot" if i % 3 == 0 else f"t{i % 50}", f"p{i}") for i in range(3000)]
    hits = spark.createDataFrame([("hot", 1), ("t1", 2), ("none", 3)], "text string, n int")
    out = merge.attach_locations(hits, spark.createDataFrame(rows, "text string, path string"))
    assert sorted((r.text, r.path, r.n) for r in out.collect()) == sorted((t, p, 1 if t == "hot" else 2) for t, p in rows if t in ("hot", "t1"))
    assert "_salt" in out._jdf.queryExecution().toString()


def test_a_budget_goes_by_the_whole_seq(spark):
    costs = [5, 7, 3, 2, 9, 1, 4, 6]
    rows = [(None, 1, f"p\x00{i:03d}", "t", c - 1) for i, c in enumerate(costs)]
    random.Random(3).shuffle(rows)
    out = model.apply_token_budget(spark.createDataFrame(rows, "bundle string, priority int, seq string, text string, tokens int").repartition(3), 16).where("admitted")
    assert sorted(int(r.seq[2:]) for r in out.collect()) == [0, 1, 2, 5]


def test_scores_leave_tasks_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(model, "SCORED_CHARS", 300)
    monkeypatch.setattr(model, "SCORED_ROWS", 7)
    texts = ["ab Cd " * (n % 9 * 10) for n in range(60)] + [None]

    def make_scorer():
        def score(some):
            assert len(some) == 1 or sum(len(t or "") for t in some) <= 300
            return [[(m.start(), m.end(), [float(m.group()[0].isupper()), 1.0]) for m in re.finditer(r"\S+", t or "")] for t in some]

        return score

    got = model.score_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), make_scorer)
    want = [(n, k, m.start(), m.end(), [float(m.group()[0].isupper()), 1.0]) for n, t in enumerate(texts) for k, m in enumerate(re.finditer(r"\S+", t or ""))]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_blocks_are_worked_on_a_few_at_a_time():
    assert [(s.start, s.stop) for s in B.row_slices([3, 3, 9, 1, 1, 0, 8], 6)] == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(B.row_slices([], 6)) == []
    pdf = B.pd.DataFrame({"logits": [np.zeros(B.BATCH_LOGITS // 2)] * 5})
    assert [len(x) for x in B.few_tokens(iter([pdf]))] == [2, 2, 1]


def test_worthy_lines_are_those_of_the_pattern(spark):
    """Its parts find what the whole pattern finds, letters of odd case among them, and it is run on lines with such letters only."""
    rnd = random.Random(5)
    bits = ["na", "me", "NAME", "Ad", "dR", "emaİl", "cıty", "ſtreet", "poſtal", "e-", "MAIL", "zıp", "İ", "K", "Anna", " ", "Berg", "é", "_", "1", "12", "-", "123", "あ", "@", "tel", "El", "𝟗", "𐐀", "Ab ", "Cd", "ß", "̇"]
    rows = [("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))),) for _ in range(5000)] + [(None,), ("",)]
    lines = spark.createDataFrame(rows, "text string")
    worthy, pattern = model.model_worthy(F.col("text")), F.col("text").rlike(P.MODEL_WORTHY)
    assert lines.where(~worthy.eqNullSafe(pattern)).count() == 0
    assert 1000 < lines.where(worthy).count() < 4900


def test_blocks_of_a_task_go_through_their_tokens_together():
    """As many steps as a stretch has tokens, whatever the blocks; the same matrices and paths as one block after the other."""
    draw = np.random.default_rng(2)
    sizes, move = [1, 200, 64, 65, 3, 128], B.moves(LABELS)
    parts = [B.log_probabilities(draw.normal(0, 2, (n, len(LABELS)))) for n in sizes]
    cut = B.Stretches(sizes, move)
    assert len(cut.active) == B.STRETCH and len(cut.at) == 4
    logp = np.concatenate(parts)
    for got, part in zip(cut.transfers(logp), parts):
        assert np.allclose(got, B.transfer(part, move))
    none, any_ = np.zeros(len(sizes), int), np.full(len(sizes), -1)
    path = cut.paths(logp, none, any_, [i for i, x in enumerate(LABELS) if x[0] in "OES"])
    assert path.tolist() == [k for part in parts for k in model.best_path(part, LABELS)]


def test_scored_blocks_are_the_tokens_of_their_texts(spark):
    texts = spark.createDataFrame([(1, "Ann Bo c " * 30), (2, None), (3, ""), (4, "Ann and  Bob"), (None, "Zed")], "doc_id long, text string")

    def make_scorer():
        return lambda some: [[(m.start(), m.end(), [0.0, 0.0, 0.0, 0.0, 4.0] if m.group()[0].isupper() else [4.0, 0.0, 0.0, 0.0, 0.0]) for m in re.finditer(r"\S+", t or "")] for t in some]

    def make_arrays():
        return lambda some: [(np.array([x[0] for x in tokens], np.int32), np.array([x[1] for x in tokens], np.int32), np.array([x[2] for x in tokens], np.float32).reshape(-1, 5)) for tokens in make_scorer()(some)]

    labels = LABELS[:5]
    blocks = model.score_blocks(texts, make_arrays, 16)
    each = {(r.bundle, r.block): (r.starts, r.alone) for r in blocks.collect()}
    assert [len(each[1, b][0]) for b in range(6)] == [16] * 5 + [10] and not each[1, 0][1] and each[4, 0] == ([0, 4, 9], True)
    got, want = model.decode_blocks(blocks, labels), model.decode_spans(model.score_tokens(texts, make_scorer), labels)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 63
