import duckdb
import pytest

from docloom.llm import linedup as ld


def brute(texts, m=1):
    """Kept lines of each text by comparing all windows."""
    seen, gone = {}, [set() for _ in texts]
    for d, t in enumerate(texts):
        rows = t.split("\n")
        for size in (1, 2) if m == 1 else (m,):
            for i in range(len(rows) - size + 1):
                run = tuple(rows[i : i + size])
                if run in seen and any(r.strip(" \t\r") for r in run):
                    gone[d].update(range(i, i + size))
                seen.setdefault(run, d)
    return ["\n".join(r for i, r in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, gone)]


def longest(texts):
    """Of each text the longest run that follows one earlier place, of the windows of its deepest power of two."""
    rows, out = [t.split("\n") for t in texts], []
    for d, mine in enumerate(rows):
        best, depth = 0, 1
        while depth <= len(mine):
            first = {}
            for i in range(len(mine) - depth + 1):
                e, j = next((e, j) for e in range(d + 1) for j in range(len(rows[e]) - depth + 1) if rows[e][j : j + depth] == mine[i : i + depth])
                if (e, j) != (d, i):
                    first[i] = (e, j)
            if not first:
                break
            best = 0
            for i in first:
                n = 1
                while i + n in first and first[i + n] == (first[i][0], first[i][1] + n):
                    n += 1
                best = max(best, depth + n - 1)
            depth *= 2
        out.append(best)
    return out


TEXTS = ["a\nb\nc\nd", "x\nb\nc\ny", "b\nc\nd\na\nb", "q\nq\nq\nq", "lone", "two words", "z\ntwo words", "", "a\nb\nc\nd", "k\n\nl\n \n\nm", "\n\nn\nk\n\nl\n \n\nm",
         "\n".join("abcdefghijklmnop"), "!\n" + "\n".join("abcdefghijkl?nop")]


@pytest.mark.parametrize("m", [1, 2, 3, 4, 7])
def test_against_brute_force(spark, m):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in ld.dedup(docs, s=ld.Settings(min_lines=m)).collect()}
    assert [kept[i] for i in range(len(TEXTS))] == brute(TEXTS, m)


def test_longest_common_prefix(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r.longest_run for r in ld.run(docs).collect()}
    assert [found[i] for i in range(len(TEXTS))] == longest(TEXTS)
    assert found[12] == 12


def test_ranks_are_suffix_order(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    x = ld.suffixes(docs)
    line = {r.s: r.r for r in x.ranked.collect()}
    pairs = {r.s: r.r for r in ld.double(ld.walk(x, x.ranked, 1)).collect()}
    for i, a in pairs.items():
        for j, b in pairs.items():
            left, right = (line[i], line[i + 1]), (line[j], line[j + 1])
            assert (a < b) == (left < right) and (a == b) == (left == right)


def test_no_floor_on_the_words_of_a_line(spark):
    """A short line at random places goes, from its second copy on; blank lines alone stay."""
    docs = spark.createDataFrame([(i, f"own {i}\n\nAll rights reserved.\n\nmore {i}") for i in range(5)], "doc_id long, text string")
    kept = [r.text for r in ld.dedup(docs).orderBy("doc_id").collect()]
    assert kept[0].count("reserved") == 1 and not any("reserved" in t for t in kept[1:])
    assert kept[1] == "own 1\nmore 1"


def test_sql(spark, sf):
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")  # noqa: F841
    want = duckdb.sql(ld.SQL).df().sort_values("doc_id").reset_index(drop=True)
    found = ld.run(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert found.equals(want[list(found.columns)])


def test_awkward_rows(docs, no_docs):
    found = ld.dedup(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    text = {r.doc_id: r.text for r in found.collect() if r.doc_id is not None}
    assert text[1].startswith("Plain") and text[2] == "" and text[6] is None and text[5] == ""
    assert ld.run(docs).count() == docs.count()
    assert ld.run(no_docs).count() == 0 and ld.dedup(no_docs).count() == 0


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "a\nb")], "doc_id long, text string")
    assert [r.text for r in ld.dedup(docs).collect()] == ["a\nb", "a\nb"]


def test_no_python_on_the_main_path(spark, sf):
    plan = ld.dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_min_lines_is_positive(docs):
    with pytest.raises(ValueError):
        ld.find_copies(docs, s=ld.Settings(min_lines=0))
