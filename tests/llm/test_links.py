"""Operators that link rows: url rules, chats, licenses, benchmark passages."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from flowscope.llm import chat_format, decontamination, license_scan, url_filter
from flowscope.llm.hashing import spaced

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("bits", [1 << 28, 100])
def test_urls_follow_the_longest_rule(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "SEGMENT_BITS", bits)
    rng = random.Random(3)
    hosts = ["com", "Example.com", "www.example.com", "a.b.example.com", "x.net", "net", "notexample.com", "", "é.net", "a..com"]
    paths = ["", "/", "/en/", "/en/x?y=/es/", "/es", "/es/1#f", "?q", "/en", "#x/en/"]
    urls = [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "http://a://b.com/en/", "://net/es/", "http://" + "a." * 3000 + "com/"]
    rows = [(i if i % 5 else None, u) for i, u in enumerate(urls)]
    rules = RULES + ([("example.com", "/en/x", "allow"), ("com", "/e", "block")] if bits < 1000 else [])
    table = spark.createDataFrame(rules + [(None, "/", "allow"), ("net", None, "block"), ("net", "/", "other")], "host string, path string, verdict string")
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as keys", "2 as hash")
    got = sorted(str(tuple(r)) for r in url_filter.judge_urls(df, table).collect())
    assert got == sorted(str((i, *judged(u, rules))) for i, u in rows)
    assert url_filter.judge_urls(df, table.limit(0)).filter("rule is not null").count() == 0
    assert url_filter.judge_urls(df.limit(0), table).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) as host", "'' as path", "xxhash64(id) as hash")
    listed = keys.filter("host % 10 = 3")
    cascade = url_filter.build_cascade(listed, keys)
    rows = keys.collect()
    got = cascade.listed(np.array([r["hash"] for r in rows], np.int64).view(np.uint64))
    assert got.tolist() == [int(r["host"]) % 10 == 3 for r in rows]
    assert len(cascade.levels) > 1 and cascade.bytes < 1500


def test_reply_order(spark):
    rows = [
        (1, 0, "user", "Hello there.\r\nHow are you?"), (1, 1, "assistant", "> How are  you\nFine."),
        (1, 2, "user", ">> How are you?\n> Fine.\nGood"), (1, 3, "user", "> Hello there.\n\nother branch"), (1, 4, "u", None),
        (1, 5, "user", "> not said before\nlast"), (2, 3000, "user", "late"), (2, 0, "user", "early"), (2, 0, "user", "early"),
        (None, 3, "user", "> early"), (3, None, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.selectExpr("*", "1 as passages", "2 as thread", "3 as body")
    got = chat_format.reply_order(wide)
    seen = {(r["conv_id"], r["turn"]): tuple(r) for r in got.collect()}
    assert got.count() == len(rows)
    assert seen[1, 1] == (1, 0, 1, 1, "assistant", "Fine.", 0, 1, 1)
    assert seen[1, 2] == (1, 0, 2, 2, "user", "Good", 1, 2, 2)
    assert seen[1, 3] == (1, 3, 0, 3, "user", "other branch", 0, 1, 1)
    assert seen[1, 4] == (1, 3, 1, 4, "u", "", 3, 0, 0)
    assert seen[1, 5] == (1, 3, 2, 5, "user", "last", 4, 1, 0)
    assert seen[2, 3000] == (2, 0, 1, 3000, "user", "late", 0, 0, 0)
    assert seen[None, 3] == (None, 3, 0, 3, "user", "", None, 1, 0)
    assert seen[3, None][1:4] == (None, 0, None)
    told = {(r["conv_id"], r["thread"]): [m["text"] for m in r["messages"]] for r in chat_format.conversations(got).collect()}
    assert told[1, 0] == ["Hello there.\nHow are you?", "Fine.", "Good"]
    assert chat_format.reply_order(df.limit(0)).count() == 0


def test_quotes_wrapped_anew(spark):
    rows = [
        (1, 0, "u", "Hello there. How are you?"), (1, 1, "a", "Something else\nentirely, at\nlength."),
        (1, 2, "u", "> Hello there. How\n> are you?\nWell."), (1, 3, "a", "> Something else entirely,\n> at length.\nYes"),
        (1, 4, "u", "> there. How are\nin part"), (1, 5, "u", "> Hello there my friend, we never said this\nno"),
        (1, 6, "u", "> Hello there. How are you?\n> Well.\nlines of two"), (2, 0, "u", "Hi\nyou"), (2, 1, "a", "x"), (2, 2, "u", "> Hi you\nshort"),
        (2, 3, "u", "> Hi you\nshort"), (2, 3, "u", "> Hi you\nshort"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_linked"]) for r in chat_format.reply_order(df).collect()}
    assert got[1, 2] == (0, 2) and got[1, 3] == (1, 2) and got[1, 4] == (0, 1) and got[1, 5] == (4, 0)
    assert got[1, 6] == (2, 2) and got[2, 2] == (0, 1) and got[2, 3] == (0, 2)


def test_no_python_in_native_plans(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    chats = spark.createDataFrame([(1, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    for df in (license_scan.license_matches(docs, license_scan.notices(spark)), chat_format.reply_order(chats)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def shares(text, template):
    words, theirs = (["".join(c if c.isalnum() else " " for c in t.lower()).split() for t in (text or "", template)])
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return len(grams(words) & grams(theirs)) / len(grams(theirs))


def test_licenses(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows, long = [], " ".join(f"clause{i}" for i in range(150))
    for i in range(60):
        _, notice = license_scan.NOTICES[i % len(license_scan.NOTICES)]
        rows.append((i, f"{filler(rng.randrange(90))} {notice.upper() if i % 2 else notice}\n{filler(rng.randrange(90))}"))
    rows += [(100, filler(5000)), (101, None), (102, ""), (103, "MIT"), (None, rows[0][1]), (0, rows[0][1])]
    rows += [(200, filler(99) + " " + long), (201, filler(50) + " " + " ".join(long.split()[:110])), (202, " ".join(long.split()[:140]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as row", "3 as start")
    templates = license_scan.notices(spark).union(spark.createDataFrame([(50, "long", long), (51, "none", None), (52, "two", "two words")]))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.license_matches(df, templates).collect()}
    for i in range(60):
        name, notice = license_scan.NOTICES[i % len(license_scan.NOTICES)]
        assert got[i, name] == 1.0
    assert (None, "MIT") in got and not any(i in (100, 101, 102, 103) for i, _ in got)
    assert got[200, "long"] == 1.0 and (201, "long") not in got and got[202, "long"] == pytest.approx(138 / 148)
    texts = dict(rows)
    for (i, name), c in got.items():
        assert max(shares(texts[i], t) for t in [long] + [t for n, t in license_scan.NOTICES if n == name]) >= c
    assert license_scan.license_matches(df.limit(0), templates).count() == 0
    assert license_scan.license_matches(df, templates.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_bands_suffice_for_short_templates(n):
    # In a full window of class 8 there are 10 shingles, so n found ones have a similarity of n / 10 at least.
    least = min(-(-3 * k // 4) / (10 + k - -(-3 * k // 4)) for k in (n, 6))
    assert (1 - least) ** license_scan.bands_for(8, [n, 6]) <= license_scan.MISS


def test_license_texts_and_headers(spark):
    gpl = """This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of
        # the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or
        # (at your option) any later version. Foo is distributed in the hope that it will be useful, but WITHOUT ANY
        # WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        # General Public License for more details. You should have received a copy of the GNU General Public License
        # along with Foo. If not, see <https://www.gnu.org/licenses/>."""
    filler = " ".join(f"w{i}" for i in range(300))
    texts = [(n, f"{filler[: 37 * i]} {t}\n{filler[: 11 * i]}") for i, (n, t) in enumerate(license_scan.WHOLE + license_scan.HEADERS)]
    texts += [("GPL-2.0", gpl.format(2)), ("GPL-3.0", filler + gpl.format(3))]
    bsd = license_scan.WHOLE[2][1].replace("copyright holder nor", "University nor")
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(900, f"{license_scan.WHOLE[0][1]} {bsd}"), (901, filler)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in license_scan.license_matches(df, license_scan.license_templates(spark)).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert found == {i: {n} for i, (n, _) in enumerate(texts)} | {900: {"MIT", "BSD-3-Clause"}}


def test_benchmark_passages(spark):
    rng = random.Random(9)
    words = [f"b{i}" for i in range(3000)]
    items = [(i, " ".join(rng.sample(words, 40))) for i in range(30)] + [(30, "Only three words"), (31, None), (32, ""), (None, "a b c d e f g"), (0, "dup of zero " * 9)]
    filler = lambda n: " ".join(f"f{rng.randrange(900)}" for _ in range(n))
    text = dict(items)
    first = items[0][1].split()
    rows = [(i, f"{filler(50)} {text[i].upper()}. {filler(200)}") for i in range(1, 10)]
    w = text[10].split()
    rows.append((10, f"{filler(9)} {' '.join(w[20:])} {filler(9)} {' '.join(w[:20])}"))  # reordered
    rows.append((11, f"{filler(9)} {' '.join(text[11].split()[:20])}"))  # half
    rows.append((12, " ".join(" ".join(text[12].split()[k : k + 4]) + " " + filler(2) for k in range(0, 40, 4))))  # too short runs
    rows += [(13, filler(5000)), (14, None), (15, ""), (16, "xx only THREE words yy"), (None, "a-b-c-d-e-f-g"), (17, " ".join(first))]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").selectExpr("*", "1 as seeds", "2 as item", "3 as size")
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    got = decontamination.contaminations(df, benchmark)
    hits = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    assert set(hits) == {(i, i) for i in range(1, 11)} | {(16, 30), (None, None), (17, 0)}
    assert hits[10, 10]["n_tiles"] == 2 and hits[10, 10]["coverage"] == 1.0
    assert [list(s) for s in hits[10, 10]["spans"]] == [[38, 20], [9, 20]]
    assert got.count() == len(hits)
    kept = decontamination.keep_clean(df, benchmark)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [11, 12, 13, 14, 15]
    assert decontamination.contaminations(df.limit(0), benchmark).count() == 0
    assert decontamination.contaminations(df, benchmark.limit(0)).count() == 0


def test_benchmark_passages_of_other_scripts(spark):
    items = [
        (1, "敏捷的棕色狐狸跳过了那条懒惰的老狗"), (2, "สุนัขจิ้งจอกสีน้ำตาลกระโดดข้ามสุนัข"),
        (3, "She said \"don't wait\" - and then, at last, it's done for good"), (4, "これはテストの文章です"),
    ]
    rows = [
        (1, "昨天他写道：“敏捷的棕色狐狸跳过了那条懒惰的老狗”。然后abc离开了，没有再说话。"), (2, f"เขาเขียนว่า{items[1][1]}แล้วก็ไป"),
        (3, "x y\u00a0She said “don’t\u00a0wait”—and then, at last, it’s done for good…z"), (4, "昨日、これはテストの文章です。終わり"),
        (5, "昨天我们去了公园，看到很多不同的花。"), (6, "She said nothing at all—and left"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contaminations(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in got} == {(i, i): 1.0 for i in range(1, 5)}


def test_words_of_other_scripts():
    words = lambda t: spaced(t).split()
    assert words("中a文b１，。ก็ดี") == ["中", "a", "文", "b１", "ก็", "ดี"]
    assert words("été — naïve\u00a0co\u00adop e\u0301t हिन्दी「x」") == ["été", "naïve", "coop", "e\u0301t", "हिन्दी", "x"]
    assert spaced("don't, ok") == "don't, ok"


def tiles_by_force(doc, item, match):
    """Greedy string tiling over all pairs of places."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = match - 1, None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best:
                    best, found = n, (i, d)
        if not found:
            return sorted(out)
        i, d = found
        for k in range(best):
            free_i[i + k] = free_d[d + k] = False
        out.append((i, d, best))


def test_tiles_equal_brute_force():
    rng = random.Random(7)
    for _ in range(600):
        kinds, match = rng.choice([1, 2, 4]), rng.choice([1, 3, 5])
        doc, item = ([rng.randrange(kinds) for _ in range(rng.randint(0, 25))] for _ in range(2))
        got = decontamination.tiles(np.array(doc, np.uint64), np.arange(len(doc)), np.array(item, np.uint64), match)
        assert got == tiles_by_force(doc, item, match)
        # Words left out of the document break runs like a word that no item has.
        gaps = [rng.random() < 0.2 for _ in doc]
        kept = [i for i, gap in enumerate(gaps) if not gap]
        got = decontamination.tiles(np.array([doc[i] for i in kept], np.uint64), np.array(kept, np.int64), np.array(item, np.uint64), match)
        assert got == tiles_by_force([99 if gap else w for w, gap in zip(doc, gaps, strict=True)], item, match)


def test_tiles_of_repeated_words_end():
    began = time.monotonic()
    same = np.full(20_000, 5, np.uint64)
    assert decontamination.tiles(same, np.arange(20_000), same[:200], 5) == [(0, 0, 200)]
    two = np.array(random.Random(1).choices([3, 4], k=20_000), np.uint64)
    got = decontamination.tiles(two, np.arange(20_000), two[7000:7200], 5)
    assert sum(n for _, _, n in got) == 200
    assert time.monotonic() - began < 5


def test_short_items_match_whole_texts_only(spark):
    rows = [(1, "Yes."), (2, "yes yes"), (3, "He said yes to her"), (4, "thank YOU"), (5, "say thank you now"), (6, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "Thank you"), (3, "two three four")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(df, items).collect()}
    assert got == {(1, 1), (4, 2), (6, 3)}
