import random
import re
from collections import Counter

from climaspark.llm import license_scan as L
from climaspark.llm.queries import op3_license_scan, table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def places(w):
    return sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_whole_table_by_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = op3_license_scan(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words(texts[r["doc_id"]])
        p = places(w)
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(p), ",".join(sorted({x for _, x in p})))
        assert (r["first_word"], r["last_word"]) == ((p[0][0], p[-1][0]) if p else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_repeated_and_broken_phrases(spark, documents):
    d = documents([(1, "MIT License, mit license. Cc, BY cc by! gnu general license"), (2, "general public license gnu"), (3, "xmit license")])
    got = {r["doc_id"]: r for r in L.scan(d).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (4, 0, 6, "cc-by,mit")
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "" and got[3]["n_base"] == 0


def test_merged_diagonals(spark, documents):
    text = next(t for t, label in L.TEMPLATES.items() if label == "mit-text").split()
    gap = " ".join(text[:10] + ["really"] + text[10:])
    half = " ".join(text[: len(text) // 3])
    got = {r["doc_id"]: r for r in L.scan(documents([(1, f"a b {gap} c"), (2, half), (3, " ".join(text))])).collect()}
    assert "mit-text" in got[1]["labels"] and "mit-text" not in got[2]["labels"] and 0 < got[2]["score"] < L.COVERED
    assert got[3]["score"] == 1 and got[1]["score"] < 1


def test_last_word_tells_versions_apart(spark, documents):
    got = L.scan(documents([(1, "Licensed under the GNU General Public License, version 3.")])).first()
    assert got["labels"] == "gpl,gpl-3.0" and got["base_labels"] == "gpl"


def test_odd_rows(spark, odd):
    got = L.scan(odd).collect()
    assert len(got) == odd.count() and all(r["score"] == 0 for r in got) and L.scan(odd.where("false")).count() == 0


def aligned(text, template, k):
    """Votes by diagonal, by comparing every k-gram with every place."""
    votes = Counter()
    for i in range(len(text) - k + 1):
        for j in range(len(template) - k + 1):
            if text[i : i + k] == template[j : j + k]:
                votes[i - j] += 1
    return votes


def test_votes_by_brute_force(spark, documents):
    rng, vocabulary = random.Random(2), "a b c the of this software license".split()
    rows = []
    for i in range(40):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            part = rng.choice([*L.PHRASES, *L.TEMPLATES]).split()
            cut = sorted(rng.sample(range(len(part) + 1), 2))
            at = rng.randrange(len(t) + 1)
            t[at:at] = part[cut[0] : cut[1]]
        rows.append((i, " ".join(t)))
    got = {(r["doc_id"], r["template"], r["diagonal"]): r["votes"] for r in L.votes(documents(rows)).where("template is not null").collect()}
    want = {}
    for n, (template, k) in enumerate([*((p, L.PHRASE_GRAM) for p in L.PHRASES), *((p, L.GRAM) for p in L.TEMPLATES)]):
        for i, t in rows:
            want |= {(i, n, d): v for d, v in aligned(t.split(), template.split(), k).items()}
    assert got == want
