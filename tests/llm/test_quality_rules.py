import re
from collections import Counter

from tracewright.llm import quality_rules as qr
from tracewright.llm.common import documents

SCHEMA = "doc_id long, text string, source string, lines int, w string, rid int"


def brute(rows, percent, most, least_words, least_share):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))).strip(" ")
    lines = [[x for x in (t or "").split("\n") if word.search(x)] for _, t, *_ in rows]
    seen = Counter()
    for (_, _, s, *_), ls in zip(rows, lines):
        seen.update({(s, norm(x)) for x in ls})
    docs = Counter(s for _, _, s, *_ in rows)
    out = []
    for (i, t, s, *_), ls in zip(rows, lines):
        ws = word.findall(t or "")
        grams = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        n = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        gone = sum(len(word.findall(x)) for x in ls if seen[s, norm(x)] > most and 100 * seen[s, norm(x)] > percent * docs[s])
        failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
        left = len(ws) - gone
        out.append((i, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(hit), failed, not failed and left >= least_words and left >= least_share * len(ws), gone))
    return out


def test_matches_brute_force(spark):
    prose = lambda k, n: " ".join(f"w{k}_{j}é" for j in range(n))
    rows = [(k, f"Read MORE  at page {k}\n{prose(k, 3 + k)}\nread more at\tpage 7", "s") for k in range(30)]
    rows += [(40, None, "s"), (41, "", "s"), (42, " \n\t\n", None), (43, "a b c d e f g a b c d e f a b c d e x y z", None), (44, "a a a a a a a a a a a a", "s"), (45, "# | <x>\n# | <x>\n" + prose(1, 30), "s"), (3, prose(2, 12), "s"), (None, prose(5, 15), None), (46, prose(9, 12000) + "\n" + prose(9, 6), "t")]
    rows += [rows[0], (47, "a b c d e\na b c d e f\n" + prose(3, 50), "t")]
    docs = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], SCHEMA)
    for percent, most in ((2, 5), (50, 3), (90, 1)):
        got = qr.filter_by_lines(docs, percent, most)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, percent, most, 10, 0.3), key=str)


def test_the_given_tables_have_boilerplate_and_depleted_documents(spark):
    got = qr.filter_by_lines(documents(spark, "/root/testdata/sf0.01"))
    assert got.where("n_removed_words > 0").count() > 20
    assert got.where("not base_failed and not kept").count() > 0


def test_empty_table(spark):
    assert qr.filter_by_lines(spark.createDataFrame([], SCHEMA)).collect() == []
