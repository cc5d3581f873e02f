"""Memory and time of the search tables for a large benchmark, and awkward items."""

import subprocess
import sys
import textwrap

from fundloom.llm import decontaminate


def test_tables_of_a_full_pass_are_small():
    code = textwrap.dedent(
        """
        import random, resource
        from fundloom.llm.decontaminate import PASS_BYTES, Tables, find
        rng = random.Random(1)
        words = [f"w{k}" for k in range(60_000)]
        items, size = [], 0
        while size < PASS_BYTES:
            t = " ".join(rng.choices(words, k=300))
            items.append((len(items), t)); size += len(t)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        tables = Tables(items)
        after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        n, hits, names = find(tables, "x y " + items[77][1] + " z")
        assert hits == [(2, 301)] and "77" in names, (hits, names)
        print((after - before) // 1024, tables.bytes_held() >> 20)
        """
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=decontaminate.__file__.rsplit("/", 3)[0]).stdout.split()
    assert int(out[0]) < 300 and int(out[1]) < 80, out


def test_passes_give_one_answer(spark):
    texts = [f"p{i} " + " ".join(f"k{(i * j) % 97}" for j in range(40)) for i in range(60)]
    benchmark = spark.createDataFrame([*enumerate(texts), (None, texts[5]), (5, texts[5]), (61, ""), (62, None), (63, "k1")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {texts[i][:200]} after", "v") for i in range(60)] + [(None, None, "w"), (100, "", "x"), (101, "k1", "y"), (101, "k1", "y")], "doc_id long, text string, benchmark_found string")
    one = sorted(map(str, decontaminate.decontaminate(docs, benchmark).collect()))
    for size in (3000, 500):
        assert sorted(map(str, decontaminate.decontaminate(docs, benchmark, pass_bytes=size).collect())) == one
        kept = decontaminate.clean_of_benchmark(docs, benchmark, pass_bytes=size)
        assert kept.columns == docs.columns and sorted(r.benchmark_found for r in kept.collect()) == ["w", "x"]
    assert any("null" in x for x in one)


def test_very_long_text():
    tables = decontaminate.Tables([(1, "a b c d e f g h i j k")])
    n, hits, names = decontaminate.find(tables, "z " * 500_000 + "a b c d e f g h i j k")
    assert (n, hits, names) == (500_011, [(500_000, 500_010)], ["1"])
