"""Line dedup against brute force: every run of enough words that occurs at an earlier place."""

import random

from fundloom.llm import linedup


def brute(texts: list[str], least: int) -> dict[int, set[int]]:
    """Numbers of the lines to delete, by document: all runs of lines against all at earlier places."""
    docs = [[(no, line.strip(" ")) for no, line in enumerate(t.split("\n")) if line.strip(" ")] for t in texts]
    seen, gone = set(), {i: set() for i in range(len(texts))}
    for i, lines in enumerate(docs):
        for a in range(len(lines)):
            here = []
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[i] |= {no for no, _ in lines[a : b + 1]}
                    here.append(run)
            seen |= set(here)
    return gone


def test_random_line_sequences_with_wordless_lines(spark):
    rng = random.Random(7)
    lines = ["\t", "\r", "a", "b", "one two", "three  four five ", "", "x y z w"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    texts += ["\n".join(["a", "\r"] * 70), "b\n" + "\n".join(["a", "\r"] * 70), texts[3], "\n".join([texts[4], texts[5]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (4, 9):
        want = brute(texts, least)
        got = {r.doc_id: r for r in linedup.without_repeats(docs, least).collect()}
        for i, text in enumerate(texts):
            kept = [x for no, x in enumerate(text.split("\n")) if no not in want[i]]
            assert got[i].n_deleted == len(want[i]), i
            assert got[i].text == "\n".join(kept)


def test_maximal_runs_have_their_source(spark):
    passage = [f"line {i} with some words" for i in range(6)]
    texts = ["\n".join(["head", *passage, "tail"]), "\n".join(["other", "", *passage, "end"]), "\n".join(passage[2:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in linedup.repeated_runs(docs, 10).collect())
    assert got == [(1, 2, 7, 0, 1, 6), (2, 0, 3, 0, 3, 4)]


def test_callers_columns_and_repeated_rows(spark):
    run = "\n".join(f"line {i} of a passage with a good many words" for i in range(9))
    rows = [(None, run, 5, "k"), (1, run, 6, "l"), (1, run, 7, "m"), (2, None, 8, "n"), (3, "word " * 300_000, 9, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seq int, `key` string")
    got = linedup.without_repeats(docs)
    assert got.columns[:4] == docs.columns
    by = {r["key"]: r for r in got.collect()}
    assert by["k"].text == run and by["l"].text == by["m"].text == "" and by["n"].text is None and by["o"].text == "word " * 300_000


def test_cut_repeats_keeps_columns_named_like_counts(spark):
    run = "\n".join(f"line {i} of a passage with a good many words" for i in range(9))
    docs = spark.createDataFrame([(1, run, 5), (2, run, 6)], "doc_id long, text string, n_lines int")
    got = linedup.cut_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, run, 5), (2, "", 6)]
