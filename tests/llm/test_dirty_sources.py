"""Thresholds of the quality rules where a source, or the whole table, is dirty, and where one group differs."""

import pytest

from weirflow.llm.quality_rules import quality_rules


def text(i, junk):
    words = [f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(30)]
    return " ".join(w[:4] + "##$" if junk else w for w in words) if junk != "lines" else "\n".join(["one two three"] + [" ".join(words[k : k + 5]) + "\n" + " ".join(words[k : k + 2]) + "\n" + " ".join(words[k : k + 2]) + "\n" + " ".join(words[k : k + 2]) for k in (0, 5, 10)])


def got(spark, rows):
    return quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()


@pytest.mark.parametrize("junk", [True, "lines"])
def test_junk_of_a_dirty_source_goes(spark, junk):
    rows = [(i, text(i, i % 5 < 2 and junk), "en", "dirty") for i in range(100)] + [(1000 + i, text(i, False), "en", f"s{i % 3}") for i in range(300)]
    kept = {r.doc_id for r in got(spark, rows) if r.kept}
    assert kept == {i for i, t, _, s in rows if s != "dirty" or i % 5 >= 2}


def test_junk_of_a_dirty_table_goes(spark):
    rows = [(i, text(i, i % 5 < 2), "en", "only") for i in range(100)]
    assert {r.doc_id for r in got(spark, rows) if r.kept} == {i for i in range(100) if i % 5 >= 2}


def test_a_language_of_long_words_keeps_its_threshold(spark):
    rows = [(i, " ".join("x" * (14 + (i + j) % 3) + str(j) for j in range(20)), "fi", "a") for i in range(100)] + [(1000 + i, text(i, False), "en", "a") for i in range(300)]
    assert all(r.kept for r in got(spark, rows))


@pytest.mark.parametrize("usual", [False, True])
def test_one_group_decides_on_its_own_rows(spark, usual):
    """The same text with a symbol in each third word goes where symbols are rare, and stays in a source where they are usual."""

    def marked(i, n):
        return " ".join(w + "#" * (j % 30 < n) for j, w in enumerate(text(i, False).split()))

    rows = [(i, marked(i, 6 if usual else 0), "en", "code") for i in range(400)] + [(1000 + i, text(i, False), "en", f"s{i % 3}") for i in range(300)]
    rows += [(5000, marked(3, 10), "en", "code"), (5001, marked(3, 10), "en", "s1")]
    kept = {r.doc_id for r in got(spark, rows) if r.kept}
    assert {r[0] for r in rows if r[0] < 5000} <= kept
    assert (5000 in kept) == usual and 5001 not in kept


def test_both_tails_of_word_length(spark):
    rows = [(i, text(i, False), "en", "a") for i in range(100)] + [(900, " ".join("abcdefghij"[j % 10] for j in range(31)), "en", "a"), (901, " ".join(f"{'longword' * 4}{j}" for j in range(30)), "en", "a")]
    assert {r.doc_id for r in got(spark, rows) if not r.kept} == {900, 901}


def test_columns_with_names_of_the_operator_come_back(spark):
    df = spark.createDataFrame([(1, text(1, False), "en", "a", 7, True)], "doc_id long, text string, lang string, source string, n_words long, Kept boolean")
    r = quality_rules(df, extra=["n_words", "Kept", "lang"]).first()
    assert (r.n_words, r.n_words_in, r.Kept_in, r.kept, r.lang) == (30, 7, True, True, "en")
