import random

import numpy as np
import pytest

from weftline.llm.language import PLACEHOLDERS, best_path, languages, lines_of, load_model, sample_labelled, save_model, train

PROSE = {"en": "the and that with from each which were this there", "de": "der und nicht mit von jede welche wurde diese dort", "fr": "le et pas avec de chaque quelle cette sont dans"}


def line(lang, rng):
    if lang in PROSE:
        return " ".join(rng.choice(PROSE[lang].split()) for _ in range(9)).capitalize() + "."
    n = rng.randrange(99)
    return rng.choice({"python": [f"def run_{n}(x):", f"    return [k for k in x if k > {n}]", f"import mod{n}"], "sql": [f"SELECT a{n} FROM t{n}", f"WHERE b = {n} AND c IS NOT NULL", f"GROUP BY a{n};"]}[lang])


def doc(lang, rng, n=14):
    return "\n".join(line(lang, rng) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    langs = [*PROSE, "python", "sql"]
    texts = [(doc(k, rng), k if rng.random() > 0.08 else rng.choice(langs)) for k in langs for _ in range(60)]
    return train([t for t, _ in texts], [k for _, k in texts])


def run(spark, model, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, y string, role string, lang string")
    return [tuple(r) for r in languages(df, "doc_id", "text", "y", model).select("doc_id", "role", "lang", "confidence").collect()]


def test_held_out_accuracy(spark, model):
    rng = random.Random(9)
    rows = [(i, doc(k, rng), k) for i, k in enumerate([*PROSE, "python", "sql"] * 30)]
    own = {d: lang for d, role, lang, c in run(spark, model, rows) if role == "own"}
    assert np.mean([own[i] == k for i, _, k in rows]) > 0.98


def test_segments_and_comments(spark, model):
    rng = random.Random(5)
    a = doc("python", rng, 12) + '\nQ = """\n' + doc("sql", rng, 8) + '\n"""\n\n' + doc("python", rng, 12)
    short = doc("python", rng, 12) + '\nQ = """\n' + doc("sql", rng, 4) + '\n"""\n' + doc("python", rng, 12)
    comments = "\n".join("# " + line("en", rng) for _ in range(9)) + "\n" + doc("python", rng, 12)
    crlf = (doc("en", rng, 12) + "\n" + doc("de", rng, 9)).replace("\n", "\r\n")
    got = run(spark, model, [(1, a, None), (2, short, None), (3, comments, None), (4, crlf, None)])
    assert {(d, r, x) for d, r, x, _ in got} == {(1, "own", "python"), (1, "segment", "sql"), (2, "own", "python"), (3, "own", "python"), (4, "own", "en"), (4, "segment", "de")}
    assert all(0 < c <= 1 for *_, c in got)


def test_edges(spark, model):
    got = run(spark, model, [(1, None, "en"), (2, "", None), (3, " \n\t\n", None), (4, "# " + line("en", random.Random(2)), None), (5, "\n".join([line("en", random.Random(3))] * 20_000), None)])
    assert sorted((d, r) for d, r, *_ in got) == [(4, "own"), (5, "own")]
    none = spark.createDataFrame([(1, "some text " * 9, None), (2, "x" * 50, "?")], "doc_id long, text string, y string")
    assert languages(none, "doc_id", "text", "y").count() == 0
    assert "?" in PLACEHOLDERS


def test_best_path_equals_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(0, 3, (6, 3))
        cost = lambda p: sum(x[i, k] for i, k in enumerate(p)) - 2.5 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=6), key=cost)
        assert cost(tuple(best_path(x, 2.5))) == pytest.approx(cost(best))


def test_lines_and_blocks():
    raw = b"/*\n words\n more\n*/\nint x;\n\n# note\n#include <a>\n"
    lines = lines_of(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    assert lines.neutral.tolist() == [True, True, True, True, False, False, True, False]
    assert lines.blank.tolist() == [False] * 5 + [True, False, False]


def test_triple_quotes_are_paired(spark, model):
    rng = random.Random(11)
    code = doc("python", rng, 10)
    a = 'Q = """\n' + doc("sql", rng, 8) + '\n"""\n' + code + '\ndef f():\n    """Says what it does."""\n' + doc("python", rng, 8)
    raw = a.encode() + b"\n"
    lines = lines_of(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    assert lines.neutral.sum() == 1 and lines.fence.sum() == 1
    got = run(spark, model, [(1, a, None)])
    assert {(r, x) for _, r, x, _ in got} == {("own", "python"), ("segment", "sql")}


def test_comments_behind_a_passage_are_the_hosts(spark, model):
    rng = random.Random(12)
    t = doc("python", rng, 14) + '\nQ = """\n' + doc("sql", rng, 8) + '\n"""\n' + "\n".join("# " + line("en", rng) * 3 for _ in range(12))
    got = run(spark, model, [(1, t, None)])
    assert {(r, x) for _, r, x, _ in got} == {("own", "python"), ("segment", "sql")}


def test_indentation_and_line_ends_dont_matter(model):
    rng = random.Random(13)
    t = doc("python", rng, 20)
    score = lambda s: model.evidence(lines_of(np.frombuffer(s.encode() + b"\n", np.uint8), np.array([len(s.encode()) + 1])))[0]
    assert np.allclose(score(t), score(t.replace("    ", "\t"))) and np.allclose(score(t), score(t.replace("\n", "\r\n")))


def test_made_up_languages_are_rejected(spark, model):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(9)) for _ in range(12)), None) for i in range(200)]
    own = [x for _, r, x, _ in run(spark, model, rows) if r == "own"]
    assert len(own) == 200 and sum(x is not None for x in own) < 10
    # a passage of it in a text isn't named either, and the text keeps its language
    code = doc("python", rng, 14) + "\n" + rows[0][1] + "\n" + doc("python", rng, 14)
    assert {(r, x) for _, r, x, _ in run(spark, model, [(1, code, None)])} == {("own", "python")}


def test_model_is_kept(spark, model, tmp_path):
    path = f"file://{tmp_path}/model"
    save_model(spark, model, path)
    again = load_model(spark, path)
    assert again.names == model.names and np.array_equal(again.table, model.table) and (again.heat, again.slope, again.at, again.bound) == (model.heat, model.slope, model.at, model.bound)


def test_copies_and_rare_labels_in_the_sample(spark):
    rng = random.Random(15)
    rows = [(i, doc("en", rng), "en") for i in range(300)] + [(1000 + i, doc("sql", random.Random(1)), "sql") for i in range(300)] + [(2000, doc("de", rng), "enn")]
    df = spark.createDataFrame(rows, "doc_id long, text string, y string").repartition(3)
    texts, labels = sample_labelled(df, "text", "y", rows=400)
    assert labels.count("sql") == 1 and labels.count("en") == 300 and "enn" not in labels
