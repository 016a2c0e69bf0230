"""Matching, survivors, tokenizer, mixing and text quality against brute force and on edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltsieve.llm import matching, mixing, quality, survivors, tokenizer

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello world", "a" * 3000, "ab" * 500, " \n\n  x", "naïve 🤷‍♀️ 日本語", "it's 12345.67!!", "<|endoftext|>", "\x00\x01", "ß" * 700]


def ranks():
    with open(PATH, "rb") as f:
        return tokenizer.load_ranks(f.read())


def test_transducer_equals_the_public_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    r = ranks()
    ref = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=r, special_tokens={})
    enc = tokenizer.Encoder(r, public.PATTERN)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeé \n'日本x1{}<>ing the") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    tokens = {i: t for t, i in r.items()}
    for t in texts:
        ids = enc.encode(t)
        assert ids == ref.encode_ordinary(t or "")
        assert "".join(tokenizer.decode_stream(ids, tokens)) == (t or "")


def test_tables_may_overflow(monkeypatch):
    enc = tokenizer.Encoder(ranks(), public.PATTERN)
    want = [enc.encode(t) for t in TEXTS]
    monkeypatch.setattr(tokenizer, "MAX_STATES", 5)
    monkeypatch.setattr(tokenizer, "MAX_WORDS", 2)
    small = tokenizer.Encoder(ranks(), public.PATTERN)
    assert [small.encode(t) for t in TEXTS] == want


def test_decoding_waits_for_whole_characters():
    tokens = {i: bytes([b]) for i, b in enumerate("é日".encode())}
    assert list(tokenizer.decode_stream(range(5), tokens)) == ["é", "日"]
    assert "".join(tokenizer.decode_stream([0], tokens)) == "�"


def test_encode_corpus(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    out = {r["doc_id"]: r["ids"] for r in tokenizer.encode_corpus(df, PATH, public.PATTERN).collect()}
    assert out[0] == [] and out[1] == [] and out[2] == [15496, 995] and len(out) == len(TEXTS)
    n = {r["doc_id"]: r["n_tokens"] for r in tokenizer.count_tokens(df, PATH, public.PATTERN, keep=("doc_id",)).collect()}
    assert n == {k: len(v) for k, v in out.items()}
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(df, PATH, public.PATTERN), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenizer.encode_corpus(df.limit(0), PATH, public.PATTERN).count() == 0


def test_water_filling():
    sizes, caps = {"a": 100, "b": 10, "c": 0}, {"a": 2, "b": 3, "c": 5}
    out = mixing.water_fill(sizes, {"a": 0.4, "b": 0.4, "c": 0.2}, caps, 100)
    assert out == {"a": 70.0, "b": 30.0, "c": 0.0}
    assert mixing.water_fill(sizes, {"a": 0.5, "b": 0.5}, caps, 10_000) == {"a": 200.0, "b": 30.0}
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 6)
        names = [str(i) for i in range(n)]
        z, s, c = ({k: f() for k in names} for f in (lambda: rng.randint(0, 50), rng.random, lambda: rng.randint(1, 4)))
        b = mixing.largest_exact_budget(z, s, c)
        for budget in (b, rng.random() * 200):
            got = mixing.water_fill(z, s, c, budget)
            assert all(got[k] <= c[k] * z[k] + 1e-6 for k in names)
            room = sum(c[k] * z[k] for k in names)
            assert abs(sum(got.values()) - min(budget, room)) < 1e-6 * max(1, budget)
            free = [k for k in names if z[k] and got[k] < c[k] * z[k] - 1e-6]
            ratio = [got[k] / s[k] for k in free]
            assert not ratio or max(ratio) - min(ratio) < 1e-6 * max(1, max(ratio))


def test_mixture(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(3000)] + [(5000 + i, "small", 5) for i in range(100)] + [(9000, "big", 0), (9001, None, 7), (9002, "untargeted", 9)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("bucket", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 4), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mix(sized, targets).collect()
    tokens = {}
    for r in out:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"] * r["copies"]
    assert set(tokens) == {"big", "small"} and abs(tokens["small"] / sum(tokens.values()) - 0.1) < 0.001
    assert max(r["copies"] for r in out if r["source"] == "big") <= 1 and max(r["copies"] for r in out) <= 4
    assert [tuple(r) for r in mixing.mix(sized.repartition(7), targets).orderBy("doc_id").collect()] == sorted(tuple(r) for r in out)
    s = {r["source"]: r for r in mixing.shares(mixing.mix(sized, targets, 1e9), sized, targets, 1e9).collect()}
    assert s["gone"]["tokens"] == 0 and s["gone"]["corpus_tokens"] == 0 and set(s) == {"big", "small", "gone", None, "untargeted"}
    assert s["small"]["tokens"] == 2000 and s["big"]["most_copies"] == 1 and s["untargeted"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-9
    assert mixing.mix(sized.limit(0), targets).count() == 0


KNOWN = {"the", "is", "and", "of", "in", "a", "to", "i", "we", "it", "der", "und", "das"}
PROSE = "We kept it in the shed for a month, and it is dry. I looked at the hedge and the neighbour said it is of no use to us."
CASES = [
    (PROSE, None), (None, None), ("", None), ("  \n ", None), ("[deleted]", None), ("Thanks!", None), ("\n".join(PROSE.split(". ")), None), ("\n".join(f"- item {i} blue" for i in range(9)), "list"), ("\n".join(f"oak board {w}" for w in "abcdef"), "list"),
    ("\n".join(f"{i},{i * 3},red" for i in range(8)), "table"), ("| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(5)), "table"), ("\n".join(f"{i}\tx" for i in range(5)), "table"), ("<table>\n" + "\n".join(f"<tr><td>{i}</td><td>b</td></tr>" for i in range(4)) + "\n</table>", "table"),
    ("lol " * 40, "junk"), ("🎉" * 60, "junk"), ("mfT5J1JiiZdZ890tFkXGewiRmjVyLet2KUF+hnishrbKZ4Yz2iaOLuljQ4LNCXF6x+jJ" * 3, "junk"), ("xyzzats fkncry sjfos ulaymf mafqam rkzwk qwwyj jyxqr jxtft yyajc zntrl mqyvz", "junk"), ("Ã¦Â¸Â©Ã¥Â®Â¤ã�«ã�¤ã�„ã�¦è©³ã�—ã�„äºº" * 4, "junk"),
    (PROSE + "\n- a\n- b", None), (PROSE.upper(), None), ("x" * 200_000, "junk"),
]


def test_every_kind_has_a_reason():
    for text, want in CASES:
        stats, judged = quality.both(text, KNOWN)
        n = quality.char_counts([text or ""])
        judged |= {"letter_ratio": n[1][0] / max(1, n[4][0]), "symbol_ratio": n[3][0] / max(1, n[4][0])}
        kind, failed = quality.judge(judged)
        assert failed or kind is None, (text, kind)


def test_long_tags_are_taken_off():
    tag = '<a title="' + "x" * 5000 + '">'
    assert quality.text_lines(tag + PROSE + "</a>") == [PROSE] and quality.text_lines("[url=" + "y" * 900 + "]" + PROSE + "[/url]") == [PROSE]


def test_kinds_by_example():
    for text, want in CASES:
        s = quality.analyse(text, KNOWN)
        n, letters, digits, symbols, dense = (int(x[0]) for x in quality.char_counts([text or ""]))
        if s["n_lines"]:
            s |= {"n_chars": n, "letter_ratio": letters / max(1, dense), "digit_ratio": digits / max(1, dense), "symbol_ratio": symbols / max(1, dense)}
        assert quality.judge(s)[0] == want, (text or "")[:60]


def test_statistics_are_of_the_whole_text(spark):
    reply = PROSE + " " + PROSE
    texts = ["> " + PROSE + "\n> --\n> Ann | two cats\n\n" + reply, PROSE + "\n---\n" + reply, "[quote]" + PROSE + "\n-- \nAnn[/quote]\nnot so", PROSE + "\n-- \nAnn | two cats\nMy setup: dry hands", PROSE + "\n---\n- a\n- b"]
    signed = [quality.signature_lines(t, quality.text_lines(t)) for t in texts]
    assert signed == [0, 0, 0, 3, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = quality.text_quality(docs, spark.createDataFrame([("en", w) for w in KNOWN], "lang string, word string")).orderBy("doc_id").collect()
    assert [r["n_lines"] for r in out] == [4, 3, 4, 4, 4]
    n = len(quality._WORD.findall(PROSE))
    assert [r["n_words"] for r in out] == [3 * n + 3, 3 * n, n + 3, n + 7, n + 2] and all(r["kind"] is None for r in out)
    whole, judged = quality.both(PROSE + "\n-- \n" + "Ann of the hill and mill\n" * 3, KNOWN)
    assert whole["entry_share"] > 0 and judged["entry_share"] == 0


def test_character_counts_against_brute_force():
    texts = [t or "" for t, _ in CASES] + ["ä1! \x00é"]
    got = np.array(quality.char_counts(texts)).T
    for t, row in zip(texts, got, strict=True):
        t = t.replace("\x00", " ")
        want = [len(t), sum(c.isalpha() for c in t), sum(c.isdigit() for c in t), sum(not c.isalnum() and not c.isspace() for c in t), sum(not c.isspace() for c in t)]
        assert row.tolist() == want


def test_quality_table(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string, kind string")
    words = spark.createDataFrame([("en", w) for w in KNOWN] + [("en", None)], "lang string, word string")
    out = quality.text_quality(docs, words).orderBy("doc_id").collect()
    assert [r["kind"] for r in out] == [k for _, k in CASES]
    assert out[7]["failed"] and out[0]["failed"] == [] and out[1]["n_words"] == 0
    assert quality.text_quality(docs.limit(0), words).count() == 0


def test_best_row_and_survivor(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        gid = rng.choice(["A", " a", "b", "C", "d", "e", None, " ", "n/a"]) if i < 60 else f"id{rng.randint(0, 90)}"
        pick = lambda p, v: v if rng.random() < p else rng.choice([None, "", "N/A"])
        rows.append((i, gid, rng.choice(["crm", "Web ", None, "x"]), rng.choice([None, "2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z", "junk"]), pick(0.8, "Ann"), pick(0.8, "Lee"), pick(0.7, rng.choice(["a@x.y", "b@x.y"])), pick(0.6, "0512345678"), pick(0.9, "1234")))
    cols = "row_id bigint, id string, datasource string, sourcemodifieddate string, firstname string, lastname string, email string, mobile string, postcode string"
    prof = spark.createDataFrame([("crm", "UTC", True, 1), ("web", "UTC", True, 2)], "datasource string, zone_name string, day_first boolean, trust_rank int")
    out = {r["id"]: r for r in survivors.survivors(spark.createDataFrame(rows, cols), prof).collect()}
    groups = {}
    for r in rows:
        if r[1] and r[1].strip().lower() not in ("", "n/a", "null"):
            full = sum(bool(v and v.lower() not in ("n/a", "null")) for v in r[4:])
            groups.setdefault(r[1].strip().lower(), []).append((full, r[3] if r[3] and r[3] != "junk" else "", -{"crm": 1, "web": 2}.get((r[2] or "").strip().lower(), 99), r[0]))
    want = {}
    for g, x in groups.items():
        top = [max(r[k] for r in x) for k in range(3)]
        best = [r[3] for r in x if list(r[:3]) == top]
        want[g] = min(best) if best and len(x) > 1 else None
    assert {g: r["best_row_id"] for g, r in out.items()} == want
    assert all(r["firstname"] in ("Ann", None) for r in out.values())
    assert {g: r["n_rows"] for g, r in out.items()} == {g: len(x) for g, x in groups.items()}
    assert survivors.survivors(spark.createDataFrame([], cols), prof).count() == 0


def test_quality_model_recovers_sources(spark):
    rng = np.random.default_rng(4)
    sens, false = {"a": 0.95, "b": 0.9, "c": 0.5}, {"a": 0.05, "b": 0.1, "c": 0.45}
    rows = []
    for _ in range(4000):
        truth = rng.random() < 0.5
        said = [s for s in sens if rng.random() < (sens[s] if truth else false[s])]
        if said:
            rows.append(("email", ["a", "b", "c"], said, 1))
    p = spark.createDataFrame(rows, "field string, covering array<string>, claiming array<string>, n bigint").groupBy("field", "covering", "claiming").agg(F.sum("n").alias("n"))
    theta = survivors.fit_quality(p, 40)
    assert theta[("email", "a")][0] > 0.85 and theta[("email", "a")][1] < 0.35 and theta[("email", "c")][0] < 0.75


def test_hot_group_ways_agree(spark, monkeypatch):
    said = [("hot" if i % 3 else f"g{i % 50}", f"s{i % 4}", "email", f"v{i % 400}", f"V{i % 400}", i, 1) for i in range(3000)]
    df = spark.createDataFrame(said, "gid string, source string, field string, value string, shown string, ms bigint, trust bigint")
    df = df.withColumn("row", F.struct(F.lit(1).alias("filled"), "ms", "trust", F.col("ms").alias("neg_id")))
    a = sorted(map(str, survivors.facts(df).collect()))
    monkeypatch.setattr(survivors, "HOT_ROWS", 5)
    b = sorted(str(r) for r in survivors.facts(df).select("gid", "field", "value", "claiming", "latest", "covering").collect())
    monkeypatch.setattr(survivors, "BROADCAST_ROWS", 0)
    c = sorted(str(r) for r in survivors.facts(df).select("gid", "field", "value", "claiming", "latest", "covering").collect())
    assert b == c and len(a) == len(b)


PEOPLE = "src string, id string, firstname string, lastname string, email string, mobile string, postcode string"


def people(n=60):
    rng = random.Random(1)
    syl = ["bra", "ko", "li", "ten", "mar", "vi", "sho", "du", "pel", "ran"]
    name = lambda k: "".join(rng.choice(syl) for _ in range(k)).capitalize()
    out = []
    for i in range(n):
        f, l = name(2), name(3)
        out.append((f, l, f"{f}.{rng.randrange(10**6):06d}@mail.example", f"05{rng.randrange(10**8):08d}", f"{rng.randrange(1000, 9999)}"))
    return out


def test_matching(spark):
    rows, want = [], set()
    for i, (f, l, e, m, p) in enumerate(people()):
        rows += [("unified", f"U{i}", f, l, e, m, p), ("unified", f" u{i} ", None, l.upper(), None, "+61 " + m[1:], p)]
        if i % 3 == 0:  # same person, both contacts, noisy writing
            rows.append(("club", f"c{i}", f[:1] if i % 2 else f, l, "mailto:" + e.upper(), m, None))
            want.add((f"c{i}", f"u{i}"))
        if i % 3 == 1:  # one contact changed, the other mistyped
            rows.append(("event", f"e{i}", f, l, e.replace("@", "q@"), "0699999999", p))
            want.add((f"e{i}", f"u{i}"))
        if i % 3 == 2:  # household: same contact and last name, another first name
            rows.append(("club", f"h{i}", "Zzyx" + "abcdefgh"[i % 8], l, e, m, p))
        rows += [("club", "crowd", f, l + str(k), e, m, p) for k in range(2)]
    rows += [("club", None, "a", "b", "c@d.e", "0511111111", "1"), ("event", "empty", None, "n/a", "", None, "null")]
    got = {tuple(sorted((r["id_a"], r["id_b"]))) for r in matching.match_records(spark.createDataFrame(rows, PEOPLE)).collect()}
    assert got == want
    assert matching.match_records(spark.createDataFrame([], PEOPLE)).count() == 0


def test_third_id(spark):
    a, b = people(2)
    rows = [("unified", "u", a[0], a[1], a[2], None, a[4]), ("club", "c", a[0], a[1], a[2], a[3], a[4]), ("event", "e", a[0], a[1], None, a[3], a[4]), ("event", "x", b[0], b[1], b[2], b[3], b[4])]
    rows += [("unified", f"f{i}", *p) for i, p in enumerate(people(40)[2:])] + [("club", f"g{i}", *p) for i, p in enumerate(people(40)[2:])]
    out = {(r["id_a"], r["id_b"]): r["via"] for r in matching.match_records(spark.createDataFrame(rows, PEOPLE)).filter("id_a in ('u', 'c', 'e', 'x') and id_b in ('u', 'c', 'e', 'x')").collect()}
    assert {tuple(sorted(k)): v for k, v in out.items()} == {("c", "u"): None, ("c", "e"): None, ("e", "u"): "c"}


def compared(spark, rows):
    prof, members = matching.classes(matching.profiles(spark.createDataFrame(rows, PEOPLE)))
    pairs = matching.compare(matching.candidates(prof), prof).filter("x is not null").select("src_a", "id_a", "src_b", "id_b")
    return {(r["id_a"], r["id_b"]) for r in matching.expand(pairs, members).collect()}


def test_block_size_decides_nothing(spark, monkeypatch):
    names = [(None, None), ("Ann", None), (None, "Lee")] + [(f"Nam{chr(97 + i % 20)}o", f"Last{i % 7}") for i in range(37)]
    rows = [(s, f"{s}{i}", *n, "shared@mail.example", f"05{i * 7919 % 10**8:08d}" if i % 2 else None, "1000" if i % 3 else None) for s in ("club", "event") for i, n in enumerate(names)]
    whole = compared(spark, rows)
    monkeypatch.setattr(matching, "HOT_IDS", 3)
    assert compared(spark, rows) == whole
    post, phone = (lambda i: i % 3 > 0), (lambda i: i % 2 > 0)
    letters = [matching._letters(([], [], *[[matching.fold(x)] if x else [] for x in n])) for n in names]
    want = {(f"club{i}", f"event{j}") for i in range(40) for j in range(40) if post(i) and post(j) or letters[i] & letters[j] or i == j and phone(i)}
    assert whole == want and ("club0", "event0") not in whole and ("club1", "event1") in whole


def test_copies_and_crowds(spark):
    p = people(1)[0]
    rows = [(s, f"{s}{i}", *p) for s in ("club", "event") for i in range(70)]
    rows += [("unified", "one", p[0], p[1] + "x" * (i % 15), p[2], p[3], p[4]) for i in range(60)]  # misspelt often, still one person
    rows += [("unified", "all", f"F{i}", f"L{i}", f"a{i}@mail.example", f"05{i:08d}", p[4]) for i in range(5)] + [("club", "last", "F3", "L3", "a3@mail.example", "0500000003", p[4])]
    got = {tuple(sorted((r["id_a"], r["id_b"]))) for r in matching.match_records(spark.createDataFrame(rows, PEOPLE)).collect()}
    ids = [f"{s}{i}" for s in ("club", "event") for i in range(70)]
    assert got == {tuple(sorted((a, b))) for a in ids for b in ids if a[0] < b[0]} | {tuple(sorted((a, "one"))) for a in ids}


def test_long_values(spark):
    f, l, e, m, p = people(1)[0]
    rows = [("club", "c", f, l, "x" * 100_000 + "@" + "y" * 100_000, m, p), ("event", "e", f, l, e, m, "9" * 100_000), ("event", "f", f * 20_000, l, "a@" + "b" * 255, "5" * 50_000, p), ("club", "g", None, l * 9_000, "a@" + "b" * 254, None, p)]
    assert {("c", "e"), ("f", "g")} >= {tuple(sorted((r["id_a"], r["id_b"]))) for r in matching.match_records(spark.createDataFrame(rows, PEOPLE)).collect()} >= {("c", "e")}


def test_names_share_outer_letters():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in "ab")
        if matching.name_similarity(a, b) >= 0.7:
            assert {*a[:2]} & {*b[:2]} or {*a[-2:]} & {*b[-2:]}, (a, b)


def test_near_contacts_are_always_compared(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):  # one edit in the only contact; neither last name nor postcode agree
        mail, e = "".join(rng.choice("abcdefgh12345678") for _ in range(12)), i % 3
        k = rng.randrange(1, 11)
        near = (mail[:k] + mail[k + 1 :], mail[:k] + "z" + mail[k + 1 :], mail[:k] + mail[k + 1] + mail[k] + mail[k + 2 :])[e]
        rows += [("club", f"c{i}", "Ann", f"L{i}xy", mail + "@mail.example", None, f"1{i:03d}"), ("event", f"e{i}", "Ann", f"Q{i}uv", near + "@mail.example", None, f"9{i:03d}")]
        digits = f"5{rng.randrange(10**8):08d}"
        near = (digits[:k] + digits[k + 1 :], digits[:k] + str(rng.randrange(10)) + digits[k + 1 :], digits[-8:])[e]
        rows += [("club", f"m{i}", "Ann", f"L{i}xy", None, "0" + digits, f"1{i:03d}"), ("event", f"n{i}", "Ann", f"Q{i}uv", None, "0" + near, None)]
    pairs = {(r["id_a"], r["id_b"]) for r in matching.candidates(matching.profiles(spark.createDataFrame(rows, PEOPLE))).collect()}
    assert {(a + str(i), b + str(i)) for i in range(150) for a, b in ("ce", "mn")} <= pairs


def test_contact_keys_against_similarities(spark):
    rng = random.Random(11)
    emails, mobiles = set(), set()
    for _ in range(120):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = rng.choice(["", "a", "b", "cc"])
        emails |= {a + "@xx.example", "".join(b) + rng.choice(["@xx.example", "@x.exmple", "@other.test"])}
        m = str(rng.randrange(10 ** rng.randint(6, 8), 10**9))
        mobiles |= {x for x in (m, m[-7:], m[1:], m[:3] + m[4:], m[:2] + m[3] + m[2] + m[4:]) if len(x) >= 7}
    values = spark.createDataFrame([("email", v) for v in emails] + [("mobile", v) for v in mobiles], "kind string, value string")
    got = {tuple(r) for r in matching.near_values(values).collect()}
    want = {(k, a, b) for k, f, vs in (("email", matching.email_similarity, emails), ("mobile", matching.mobile_similarity, mobiles)) for a in vs for b in vs if a != b and f(a, b) >= matching.CLOSE}
    assert got == want and len(want) > 300


def test_most_pairs_of_dense_mobiles_end_before_python(spark):
    rng = random.Random(17)
    mobiles = [f"5{k:05d}77" for k in rng.sample(range(10**5), 1000)]
    at, keys = matching.contact_keys("mobile", mobiles)
    by = {}
    for i, k in zip(at.tolist(), keys.tolist(), strict=True):
        by.setdefault(k, set()).add(mobiles[i])
    pairs = sorted({("mobile", a, b) for vs in by.values() for a in vs for b in vs if a < b})
    kept = {tuple(r) for r in spark.createDataFrame(pairs, "kind string, a string, b string").filter(matching._may_be_close()).collect()}
    close = {p for p in pairs if matching.mobile_similarity(*p[1:]) >= matching.CLOSE}
    assert close <= kept and len(kept) < 1.2 * len(close) and len(close) < 0.5 * len(pairs)


def test_edit_against_the_whole_table():
    def whole(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(23)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "ab")
        assert all(matching.edit(a, b, most) == min(whole(a, b), most + 1) for most in (1, 2, 3)), (a, b)


def test_two_edits_are_found_by_bands(spark):
    rng, rows = random.Random(3), []
    for i, (f, l, e, m, p) in enumerate(people(200)):
        k = rng.randrange(1, 6)
        rows += [("club", f"c{i}", f, l, e, None, p), ("event", f"e{i}", f, l, e[:k] + "q" + e[k + 1 : k + 6] + e[k + 7 :], None, p)]
    got = compared(spark, rows)
    assert len({(f"c{i}", f"e{i}") for i in range(200)} & got) >= 190


def test_calibration(spark):
    rng = np.random.default_rng(0)
    x = rng.random((2000, 9)).round(3)
    x[:, 5] = 0
    x[:1000, [0, 1, 2, 3]], x[1000:, 2], x[1000:, 0] = 1.0, 0.0, 1.0
    df = spark.createDataFrame([(f"a{i}", f"b{i}", r.tolist()) for i, r in enumerate(x)], "id_a string, id_b string, x array<double>")
    out = {r["bin"]: r for r in matching.calibration(df, matching.train(df)).collect()}
    assert sum(r["n"] for r in out.values()) == 2000 and out[9]["share_same"] > 0.95 and out[0]["share_same"] < 0.05


def test_similarities():
    assert matching.edit("abcd", "abdc") == 1 and matching.edit("abc", "xyz", 2) == 3 and matching.edit("", "ab") == 2
    assert matching.fold("Säirnta") == matching.fold("Saeirnta") == matching.fold("sairnta")
    assert matching.name_similarity("t", "thaxel") == 0.8 and matching.name_similarity("jun", "junda") == 0.9 and matching.name_similarity("trulla", "turlla") == 0.9 and matching.name_similarity("geivi", "quoskrin") == 0
    x = np.random.default_rng(0).normal(size=(4000, 2))
    y = (np.random.default_rng(1).random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    w = matching.fit_logistic(x, y, 1e-6)
    assert np.abs(w[1:] - [2, -1]).max() < 0.25
