import random

from quillgraph.llm import licenses as L
from quillgraph.llm.tables import table

SF = "/root/testdata/sf0.01"


def plain_scan(text, templates=L.TEMPLATES, containment=L.CONTAINMENT):
    """Every window against every template, without hashes."""
    words = L.words_of(text)
    out = []
    for name, t in sorted(templates.items()):
        tw = L.words_of(t)
        k = min(5, len(tw))
        runs = [tuple(tw[i : i + k]) for i in range(len(tw) - k + 1)]
        mine = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        best = None
        for first in range(0, max(len(mine) - (len(runs) if len(mine) > len(runs) else 0), 1), len(runs)) if mine else []:
            window = mine[first : first + 2 * len(runs)]
            hit = [i for i, r in enumerate(window) if r in set(runs)]
            share = len({window[i] for i in hit}) / len(set(runs))
            if share >= containment - 1e-9 and (best is None or share > best[0]):
                at = [window.index(window[i]) + first for i in hit]
                best = share, min(at), max(at) + k - min(at)
        if best:
            out.append((name, *best))
    return out


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = [(d, *hit) for d, t in rows for hit in plain_scan(t)]
    got = [tuple(r) for r in L.op2_license_scan(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5


def test_noisy_copies():
    rng = random.Random(4)
    scanner = L.Scanner(L.TEMPLATES)
    fill = [f"w{i}" for i in range(50)]
    for _ in range(300):
        name, t = rng.choice(list(L.TEMPLATES.items()))
        words = t.split()
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], ["changed"], [words[i].upper()], [words[i], "new"]])
        text = " ".join([*rng.choices(fill, k=rng.randint(0, 60)), *words, *rng.choices(fill, k=rng.randint(0, 60))])
        assert scanner.scan(text) == plain_scan(text)


def test_bands_meet_the_recall():
    for t in L.Scanner(L.TEMPLATES).templates:
        j = t.need / (2 * t.n + len(t.shingles) - t.need)
        assert 1 - (1 - j) ** t.bands >= L.RECALL


def test_edges(spark):
    mit = L.TEMPLATES["MIT"]
    rows = [(None, mit), (1, None), (2, ""), (3, " \n"), (4, "..."), (5, mit), (5, mit), (6, "x " * 100_000 + mit.upper()), (7, "Released under the")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, license string")
    got = sorted((tuple(r) for r in L.scan_licenses(df).collect()), key=str)
    assert got == sorted([(d, "MIT", 1.0, w, 5) for d, w in ((None, 0), (5, 0), (5, 0), (6, 100_000))], key=str)
    assert L.scan_licenses(df.limit(0)).count() == 0
    assert L.scan_licenses(df, {}).count() == 0


def test_whole_texts_and_headers(spark):
    rng = random.Random(7)
    templates = L.all_templates()
    assert {"MIT-text", "ISC-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "Apache-2.0-text", "Apache-2.0-header", "GPL-2.0-text", "GPL-3.0-header", "LGPL-3.0-text", "AGPL-3.0-header", "MPL-2.0-text", "CC-BY-4.0-header"} <= set(templates)
    rows = []
    for name, t in templates.items():
        words = t.split()
        for _ in range(len(words) // 100):  # a word in a hundred is another
            words[rng.randrange(len(words))] = "changed"
        rows.append((name, " ".join([*rng.choices(["lorem", "ipsum", "dolor"], k=rng.randint(0, 300)), *words, "end"])))
    got = {(r.doc_id, r.license): (r.containment, r.n_words) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, text in rows:
        words, tw = L.words_of(text), L.words_of(templates[name])
        k = min(5, len(tw))
        want, has = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (tw, words))
        assert got[name, name][0] >= 0.8 and got[name, name][0] <= len(want & has) / len(want)
    assert {lic for d, lic in got if d == "ISC-text"} == {"ISC-text"}
    assert L.Scanner(templates).scan("nothing of that kind, but all rights are reserved") == []
