import random
import re
from collections import Counter

from harborline.llm.rules import COUNTS, quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 7) + str(rng.randrange(90)) + rng.choice(["", "", ",", "é", "\n", "\xa0"]) for _ in range(n))
    rows = [(i, prose(rng.randrange(60, 200)), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(x + "$$$" for x in prose(100).split()), "en", "a") for i in range(5)]
    rows += [(2000, None, "en", None), (2001, "", None, "a"), (2002, "a b a b a b a b", "en", "a"), (2003, "same line\n" * 80, "en", "a"), (2004, "x" * 100000, "en", "a"), (2005, prose(20000), "en", "a")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        r, want = got[i], brute(text)
        assert tuple(r[c] for c in COUNTS[:5]) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert all(got[i].kept for i in range(300) if not got[i].base_failed)
    assert not any(got[1000 + i].kept for i in range(5))
    assert not any(got[2000 + i].kept for i in range(5))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules(docs).count() == 0
