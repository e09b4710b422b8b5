"""Leaks, pieces, containers and handwritten source on small tables, against brute force where there is one."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import handwritten as H
from lodestone.llm import leaks as L
from lodestone.llm import packing, splitting, speech
from lodestone.llm.tokens import tokenizer

ITEM = "Betalor guards the second violin. Listen, Dorkolyor always remembers the missing page after the wedding! Dicen: Lendunsel wants to repair the cellar key"
SRT = "{n}\n00:00:{s:02},100 --> 00:00:{t:02},900\n{text}\n\n"


def cued(lines):
    return "".join(SRT.format(n=i + 1, s=i * 2, t=i * 2 + 1, text=x) for i, x in enumerate(lines))


SPOKEN = ["Betalor guards the", "second violin. Listen, Dorkolyor", "always remembers the missing", "page after the wedding!"]
CASES = {
    1: cued(["No.", *SPOKEN, "Bye."]),
    2: cued(["Betalor guards the [door creaks]", "second violin. (SIGHS) Listen,", "♪ dog barking ♪", "HENBRIPE: Dorkolyor always remembers", "the missing", "Subtitles by www.subs.example", "<i>page after the wedding!</i>"]),
    3: cued([x.upper() for x in SPOKEN]),
    4: cued(["Betalor guards thc", "sec0nd vi0lin. Listcn, Dorkolyor", "always remernbers tlie missing", "paqe after the weddinq!"]),
    5: cued(["Betalor guards the", "Betalor guards the\nsecond violin. Listen, Dorkolyor", "second violin. Listen, Dorkolyor\nalways remembers the missing", "always remembers the missing\npage after the wedding!"]),
    6: " ".join(cued(SPOKEN).split("\n")),
    7: cued(["Betalor guards the", "second vio-\nlin. Listen, Dorkolyor", "- always remembers the missing", "- page after the wedding!"]).replace("\n", "\r\n"),
    8: "WEBVTT\nKind: captions\n\n" + cued(SPOKEN).replace(",100", ".100").replace(",900", ".900"),
    9: "".join(SRT.format(n=i + 1, s=s, t=s + 1, text=SPOKEN[j]) for i, (j, s) in enumerate([(0, 0), (2, 4), (1, 2), (3, 6)])),
}
NOT = {
    21: cued(["Betalor guards the second violin. Listen, Dorkolyor always remembers the"]),  # eleven words
    22: cued(["Betalor guards the second fiddle. Listen, Dorkolyor always remembers the missing page"]),
    23: "",
    24: None,
    25: cued(["Betalor guards the second violin."]) * 400,
}


def items(spark):
    rows = [(1, ITEM), (2, "Too short to count"), (3, None), (4, "Сестра никогда не находила ворота у реки но всегда помнит чужой чемодан за сто монет"), (5, "Une infirmière fatiguée a caché la clé de la cave près du marché où l'été dernier"), (1, ITEM)]
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("doc_id", F.lit(0))


def test_leaks_in_all_disguises(spark):
    ru = cued(["Сестра никогда не находила", "ворота у реки но всегда", "помнит чужой чемодан за сто монет"])
    fr = cued(["Une infirmière fatiguée a caché", "la clé de la cave près du marché où l'été"])
    docs = {**CASES, **NOT, 11: ru, 12: ru.encode().decode("latin-1"), 13: ru.encode("cp1251").decode("latin-1"), 14: fr, 15: fr.encode().decode("latin-1"), 16: fr.encode().decode("latin-1").encode().decode("latin-1"), 17: "".join("�" if ord(c) > 127 else c for c in fr)}
    df = spark.createDataFrame(list(docs.items()) + [(None, CASES[1]), (1, CASES[1])], "doc_id bigint, text string").withColumn("item_id", F.lit(7))
    got = {tuple(r) for r in L.leaks(df, items(spark)).collect()}
    assert got == {(d, 1) for d in CASES} | {(d, 4) for d in (11, 12, 13)} | {(d, 5) for d in (14, 15, 16, 17)}


def test_leaks_of_empty_tables(spark):
    df = spark.createDataFrame(list(CASES.items()), "doc_id bigint, text string")
    assert {tuple(r) for r in L.leaks(df, items(spark)).collect()} == {(d, 1) for d in CASES}
    assert L.leaks(df.limit(0), items(spark)).count() == 0
    assert L.leaks(df, items(spark).limit(0)).count() == 0


def test_other_words_are_no_leak(spark):
    item = spark.createDataFrame([(1, "the fat cat sat on the rim of the old tin can today"), (2, "the hat rat sat on the rim of the old tin pan today and left")], "item_id bigint, text string")
    docs = [(1, "the tat eat sat on the rlm of the old tin ean today"), (2, "the fat cat sat on the rlm of the old tin can today"), (3, "the fat eat sat on the r1m of the oId tin can t0day")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in L.leaks(df, item).collect()} == {(2, 1), (3, 1)}


def test_speakers_and_songs(spark):
    loud = "\n".join(x.upper() for x in ["Listen, Dorkolyor always remembers", "BRAN: the missing page after the wedding!", "Dicen: Lendunsel wants to repair"])
    song = cued(["♪ Betalor guards the ♪", "♪ second violin. Listen, Dorkolyor ♪", "♪ always remembers the missing ♪", "♪ page after the wedding! ♪"])
    roll = cued(["A\nB", "Betalor guards the\nsecond violin.", "second violin.\nListen, Dorkolyor\nalways remembers", "Listen, Dorkolyor\nalways remembers\nthe missing page after the wedding!"])
    df = spark.createDataFrame([(1, loud), (2, song), (3, roll)], "doc_id bigint, text string")
    assert {tuple(r) for r in L.leaks(df, items(spark)).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_join_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    words = [a + b for a in "bdkmnprt" for b in ("ax", "uz", "yk")]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(12)]
    docs = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(60)]
        src, n, at = rng.choice(texts).split(), rng.randrange(8, 18), rng.randrange(40)
        start = rng.randrange(len(src) - n)
        own[at : at + n] = src[start : start + n]
        docs.append((i, " ".join(own)))
    grams = lambda t: {tuple(t.split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    want = {(d, i) for d, t in docs for i, x in enumerate(texts) if grams(t) & grams(x)}
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == want and 10 < len(want) < 60


@pytest.fixture(scope="module")
def tok():
    return tokenizer()


def test_fast_count_is_exact(tok):
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "Größe", " ", "  ", "\n", "\r\n", "\n\n\n", "\t", "12", ",", "é", " ", "日本", "😀", "'s"]) for _ in range(rng.randrange(1, 60)))
        assert tok.count(t) == len(tok.exact.encode_ordinary(t)), repr(t)


@pytest.mark.parametrize("kind", ["cues", "one line", "no space", "cjk", "emoji", "crlf"])
def test_pieces_cover_the_text_within_the_limit(tok, kind):
    rng = random.Random(kind)
    t = {
        "cues": cued([" ".join(rng.choice(["the", "Brücke", "über", "night."]) for _ in range(9)) for _ in range(200)]),
        "one line": " ".join(rng.choice(["no", "Straße", "yes.", "maybe,"]) for _ in range(4000)),
        "no space": "".join(rng.choice("abcdefgh") for _ in range(9000)),
        "cjk": "".join(rng.choice("日本語中文字大小") for _ in range(3000)),
        "emoji": "😀👍🏽" * 900,
        "crlf": cued(["Hello there, friend."] * 300).replace("\n", "\r\n"),
    }[kind]
    raw, ends = t.encode(), [0, *tok.ends(t)]
    parts = splitting.bisect(t, tok, 256, 32)
    assert len(parts) > 1 and parts[0][:2] == (0, 0) and parts[-1][2] == len(ends) - 1
    whole = b""
    for i, (first, own, end) in enumerate(parts):
        piece = raw[ends[first] : ends[end]].decode()  # no character is cut
        assert tok.count(piece) <= 256
        assert own == (parts[i - 1][2] if i else 0)
        assert i == 0 or 32 <= own - first <= 35
        whole += raw[ends[own] : ends[end]]
    assert whole == raw
    if kind == "cues":
        assert all(raw[ends[own] :].decode()[0].isdigit() for _, own, _ in parts)


def test_pieces_table(spark, tok):
    long = cued(["Where the river bends, nobody waits."] * 300)
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, ""), (5, "x " * 1500)], "doc_id bigint, text string").withColumn("piece_no", F.lit(1))
    got = splitting.pieces(df, with_text=True).collect()
    assert {r["doc_id"] for r in got} == {1} and all(tok.count(r["piece"]) <= 2048 for r in got)
    assert {r["doc_id"] for r in splitting.pieces(df, whole=True).collect()} == {1, 2, 5}
    assert {(r["doc_id"], r["bytes"], r["covered"], r["fits"]) for r in splitting.cover(df).collect()} == {(i, len(t.encode()), True, True) for i, t in ((1, long), (2, "short"), (5, "x " * 1500))}


def test_containers(spark, tok):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["sea", "Hafen", "gruzie", "nocy"]) for _ in range(rng.randrange(40, 700))), rng.choice(["hot", f"s{i}", f"s{i}"])) for i in range(400)]
    rows += [(1000 + i, rows[i][1].upper() + "  ", f"z{i}") for i in range(30)] + [(5000, "long " * 5000, "big"), (5001, None, "n"), (5002, "", "n"), (5003, "tiny text", None), (5004, "other tiny", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("container", F.lit("clash"))
    got = packing.containers(df, group=150).collect()
    sizes = {i: tok.count(t) for i, t, _ in rows if t}
    held, used = defaultdict(list), defaultdict(int)
    for r in got:
        held[r["container"]].append(r["doc_id"])
        used[r["container"]] += r["n_tokens"]
    total = defaultdict(int)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
    assert dict(total) == sizes
    assert all(n <= 2048 for n in used.values())
    assert all(used[r["container"]] == r["fill"] for r in got)
    source = {i: s for i, _, s in rows}
    text = {i: " ".join((t or "").lower().split()) for i, t, _ in rows}
    for ids in held.values():
        named = [source[i] for i in ids if source[i]]
        assert len(named) == len(set(named))
        assert len({text[i] for i in ids}) == len(ids)
    assert len(used) <= 1.15 * sum(sizes.values()) / 2048 + 1
    seen = {r["doc_id"]: (r["whole"], r["fits"], r["apart"]) for r in packing.placed(df, packing.containers(df, group=150)).collect()}
    assert set(seen.values()) == {(True, True, True)} and set(seen) == set(sizes)
    wrong = spark.createDataFrame([(0, 0, 0, 1000, 7, 2100), (1, 0, 0, 1100, 7, 2100), (400, 1, 2048, 5, 8, 5)], "doc_id bigint, piece_no int, start_token int, n_tokens int, container bigint, fill int")
    few = spark.createDataFrame([(0, "a b", "s"), (1, "A  b", "t"), (400, "x", None)], "doc_id bigint, text string, source string")
    assert {r["doc_id"]: (r["whole"], r["fits"], r["apart"]) for r in packing.placed(few, wrong).collect()} == {0: (True, False, False), 1: (True, False, False), 400: (False, True, True)}


def test_bins_take_the_tightest_compatible_one():
    b = packing.Bins(100)
    assert [b.put(60, 1, 0), b.put(70, 2, 0), b.put(30, 0, 0), b.put(40, 1, 0), b.put(40, 4, 0)] == [0, 1, 1, 2, 0]


def files(rows):
    return [(r, ".py", s, n, "code", summary, i) for i, (r, s, n, summary) in enumerate(rows)]


def test_handwritten_reasons(spark):
    rows = [
        ("src/a.min.js", 200_000, 2, None), ("src/plain.py", 4000, 100, "Small helper."), ("src/short.py", 1200, 3, None), ("src/tables.py", 900_000, 14_000, None), ("src/big.py", 300_000, 8000, None),
        ("x/vendor/quarkmap/a.js", 3000, 90, None), ("src/vendors/a.js", 3000, 90, None), ("src/quarkmap-1.2.3.js", 3000, 90, None), ("src/client-2.0.1.js", 3000, 90, None),
        ("src/gen/a.py", 3000, 90, None), ("src/generator/a.py", 3000, 90, None), ("src/a_pb2.py", 3000, 90, None), ("src/b.py", 3000, 90, "Code generated by protoweave. DO NOT EDIT."), ("src/c.py", 3000, 90, "Emits the DO NOT EDIT banner into every output file."),
        ("src/d.py", 3000, 90, "plumcss v4.1.2 | MIT License | (c) The plumcss Authors"), ("src/e.py", 3000, 90, "Adapter for the MIT-licensed map library; written for the billing team."), ("src/f.py", None, None, None), ("src/g.py", 0, 0, None), (None, 10, 1, None),
    ]
    f = spark.createDataFrame(files(rows) + [("src/plain.py", ".py", 900_000, 1, "code", None, -5), ("doc.md", ".md", 900_000, 1, "doc", None, 1)], "rel string, ext string, size bigint, lines int, kind string, summary string, seen_at int").withColumn("n", F.lit("clash"))
    s = spark.createDataFrame([("src/big.py", i) for i in range(400)] * 2 + [("src/plain.py", 1), (None, 1)], "file string, pos int")
    got = {r["rel"]: r["reason"] for r in H.found(f, s).collect()}
    assert got == {"src/a.min.js": "minified", "src/tables.py": "data", "x/vendor/quarkmap/a.js": "vendored", "src/quarkmap-1.2.3.js": "vendored", "src/gen/a.py": "generated", "src/a_pb2.py": "generated", "src/b.py": "generated", "src/d.py": "vendored"}
    assert H.found(f.limit(0), s.limit(0)).count() == 0


def test_repair_leaves_right_text_alone():
    for t in ("Größe über alles", "garçon â la carte", "Ârret", "все ещё", "naïve 100 % – ok"):
        assert speech.repaired(t) == t
