"""Leaked passages: copies, slips, splits, quotations; hashes against brute force."""

import random

from helpers import rows

from folhario.llm import leaks


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5))) for _ in range(n)]


ITEMS = [(1, " ".join(words(60, 1))), (2, " ".join(words(55, 2))), (3, None), (4, ""), (5, " ".join(words(12, 5))), (6, " ".join(words(60, 1)))]
P1, P2 = ITEMS[0][1].split(), ITEMS[1][1].split()
FILL = " ".join(words(80, 99))


def bend(ws):
    out = list(ws)
    out[5] = "outra"
    del out[12]
    out[17] = out[17][:-1] + "x"
    return " ".join(w.upper() if i % 3 else w + "," for i, w in enumerate(out))


CASES = {
    10: (f"{FILL} {' '.join(P1)} {FILL}", {1, 6}),
    11: (f"{FILL} {bend(P1[10:40])} fim", {1, 6}),
    12: (f"{' '.join(P1[20:32])} {FILL} {' '.join(P1[8:20])}", {1, 6}),
    13: (f"{FILL} {' '.join(P1[10:24])} {FILL}", set()),
    14: (f"{' '.join(P2)}\n{' '.join(P1[:25])}", {1, 2, 6}),
    15: (FILL, set()), 16: ("", set()), 17: (None, set()), 18: ("  \n", set()),
    19: (f"{FILL * 300} {' '.join(P2[5:28])}", {2}),
    20: (" ".join(P2[i] if i % 2 else "nada" for i in range(55)), set()),
}


def test_cases(spark):
    docs = spark.createDataFrame([(k, t, 1, "clash") for k, (t, _) in CASES.items()] + [(10, CASES[10][0], 2, "x")], "doc_id long, text string, item_id int, words string")
    items = spark.createDataFrame([(i, p, 3) for i, p in ITEMS], "item_id long, passage string, doc_id int")
    for block, block_words in ((2000, 10_000), (2, 10_000), (2000, 70)):
        got = rows(leaks.leaks(docs, items, block=block, block_words=block_words, bits=1 << 16), "doc_id", "item_id")
        want = sorted([(d, i) for d, (_, s) in CASES.items() for i in s] + [(10, 1), (10, 6)])
        assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, CASES[10][0])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, passage string")
    assert leaks.leaks(docs.limit(0), items).count() == 0
    assert leaks.leaks(docs, items.limit(0)).count() == 0


def test_hits_are_all_windows_that_agree_under_a_mask():
    a, b = words(30, 7), words(30, 8)
    doc = a[:8] + b[3:9] + a[10:13] + ["zzz"] + a[14:20]
    index = leaks.Index([(1, " ".join(a)), (2, " ".join(b))])
    want = {0: set(), 1: set()}
    for n, ws in enumerate((a, b)):
        for mask in leaks.MASKS:
            for k in range(len(doc) - mask[-1]):
                for q in range(len(ws) - mask[-1]):
                    if all(doc[k + p] == ws[q + p] for p in mask):
                        want[n] |= {(k + p, q + p) for p in mask}
    got = index.hits([["x"], doc, [], a[:2], a[2:4]])
    assert set(got) == {1}, "windows never reach from one document into the next"
    assert {n: got[1].get(n, []) for n in want} == {n: sorted(w) for n, w in want.items()}


def test_a_slip_next_to_an_end():
    for n in (20, 21, 22, 24):
        for at in (1, 2, n - 3, n - 2):
            quoted = P1[10 : 10 + n]
            if at in (1, n - 2):  # the lone word beyond the slip must be a telling one
                assert len(quoted[at - 1 if at == 1 else at + 1]) > 3
            text = f"{FILL} {' '.join('outra' if i == at else w for i, w in enumerate(quoted))} {FILL}"
            assert leaks.leaked(leaks.Index(ITEMS[:1]), [text]) == [[(1, n)]], (n, at)
    assert leaks.leaked(leaks.Index(ITEMS[:1]), [f"{FILL} {' '.join(P1[10:28])} outra {FILL}"]) == [[]]


def test_many_items_in_blocks(spark):
    """20,000 items that share stock phrases, in blocks and in one."""
    stock = [words(7, 1000 + i) for i in range(20)]
    own = [words(22, 5000 + i) for i in range(2000)]
    items = [(i, " ".join(stock[i % 20] + own[i % 2000][: 22 - i % 3] + words(8, 10_000 + i))) for i in range(20_000)]
    docs = [(j, f"{FILL} {items[j * 97][1]} {' '.join(stock[j % 20])}") for j in range(60)] + [(99, " ".join(" ".join(s) for s in stock))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, passage string")
    whole = rows(leaks.leaks(docs, items), "doc_id", "item_id", "words")
    assert whole == rows(leaks.leaks(docs, items, block=7000), "doc_id", "item_id", "words")
    assert {(j, j * 97) for j in range(60)} <= {(d, i) for d, i, _ in whole} and not any(d == 99 for d, _, _ in whole)


def test_words():
    assert leaks.fold("É s0,  A-b 12h (x)") == ["e", "so", "ab", "12h", "x"]
    assert leaks.near("tabeliao", "tabeliäo".replace("ä", "o")) and not leaks.near("12", "13") and not leaks.near("sol", "mar")
