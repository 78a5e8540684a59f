"""Exact dedup, language ID, toxicity, secrets, licenses and tool calls on small tables."""

import hashlib
import json
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, license_scan, secrets, tool_calls, toxicity

LONG = "word and more " * 20_000


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# -- exact dedup ------------------------------------------------------------------------------


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out |= {i: (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members}
    return out


def dedup_rows():
    rng = random.Random(1)
    texts = ["", None, " \n", "a b", "ab", "a\x0bb ", "é é", "éé", "a\xa0b", LONG, LONG + " ", *("x" * n for n in range(40))]
    return [(i, rng.choice(texts)) for i in range(300)] + [(-5, "a b"), (2**63 - 1, "ab"), (-(2**63), "é\té"), (2**63 - 2, "q q"), (-(2**63) + 1, "qq")]


@pytest.mark.parametrize(("bits", "capacity", "hot"), [(64, 1 << 24, 1_000), (64, 500, 5), (3, 500, 1_000), (1, 1, 3), (64, 1, 1_000)])
def test_dedup_like_brute_force(spark, bits, capacity, hot):
    data = dedup_rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = rows_of(exact_dedup.exact_dedup(df, hash_bits=bits, capacity=capacity, hot_rows=hot))
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == brute_dedup(data)
    chains = {r["text_sha256"]: r["chain"] for r in got.values()}
    assert (max(chains.values()) > 1) == (bits < 6)  # short keys collide, and collisions are chained
    left = exact_dedup.drop_copies(df, hash_bits=bits, capacity=capacity, hot_rows=hot)
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, x in brute_dedup(data).items() if x[2])


def test_dedup_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    odd = spark.createDataFrame([(1, "a", 7, "x"), (1, "a", 7, "x"), (None, "a ", 8, "y"), (None, None, 9, "z")], "doc_id long, text string, group_size int, sha string")
    got = exact_dedup.exact_dedup(odd).collect()
    assert sorted((r.doc_id, r.group_size, r.keep_id) for r in got if r.doc_id) == [(1, 3, 1), (1, 3, 1)]
    assert [r.kept for r in got if r.doc_id is None and r.group_size == 1] == [True]
    for most in (exact_dedup.BROADCAST_ROWS, 0):  # with and without broadcasts
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
        left = exact_dedup.drop_copies(odd)
        assert left.columns == odd.columns and left.count() == 2


def grown(spark, keys, capacity):
    rows = spark.createDataFrame([(k - (1 << 64) if k >= 1 << 63 else k, 10) for k in keys], "key long, size long")
    return rows, exact_dedup.grow(rows, capacity, 1 << 16)


def test_directory_doubles_only_where_it_must(spark):
    top = lambda p, bits, *low: [(p << (64 - bits)) + x for x in low]
    rows, made = grown(spark, [*top(0, 4, 0, 1, 2, 1 << 20), *top(1, 4, 5), *top(12, 4, 9)], 20)
    assert made.depth == 64 - 1 and sum(2 ** (64 - b.depth) for b in made.buckets) == 2**64  # 0 to 2 part at the last bits
    assert all(b.load <= 20 for b in made.buckets) and min(b.depth for b in made.buckets) == 1
    homes = {r.key: r.bucket for r in made.bucket_of(rows).collect()}
    assert len(homes) == 6 and homes[0] == homes[1] != homes[2]
    rows, made = grown(spark, [], 20)
    assert made.depth == 0 and made.buckets == [exact_dedup.Bucket(0, 0, 0, 0)] and made.bucket_of(rows).count() == 0
    rows, made = grown(spark, [7], 1)
    assert made.depth == 0 and [r.bucket for r in made.bucket_of(rows).collect()] == [0]  # one key fills no second bucket


def test_answers_come_through_the_directory(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df, capacity=300).filter("group_size = 4").count() == 200
    whole = exact_dedup.Directory.bucket_of
    # a directory that sends the same key to two buckets parts its group
    monkeypatch.setattr(exact_dedup.Directory, "bucket_of", lambda self, d, key="key": whole(self, d, key).withColumn("bucket", F.col("bucket") * 2 + (F.col("best") % 2 if "best" in d.columns else F.lit(0)).cast("int")))
    assert exact_dedup.exact_dedup(df, capacity=300).filter("group_size = 4").count() < 200


# -- language ID ------------------------------------------------------------------------------


def speech(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_languages(spark):
    rng = random.Random(3)
    lexicons = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(60)] for k, v in {"aa": ["th", "er", "on"], "bb": ["sch", "ei", "ung"], "cc": ["é", "eau", "que"]}.items()}
    data = [(i, speech(rng, lexicons[k], rng.randint(4, 80)), k, i) for i in range(240) for k in [("aa", "bb", "cc")[i % 3]]]
    data += [(900, None, "aa", 0), (901, "123 !!", "bb", 0), (902, "", None, 0), (903, data[0][1].upper() + " " * 50, None, 0), (904, LONG, None, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score int")
    known = language_id.learn(docs, F.col("doc_id") % 4 != 1)
    assert sorted(k for k, _ in known) == ["aa", "bb", "cc"]
    got = rows_of(language_id.identify(docs, known))
    held = [r for r in data[:240] if r[0] % 4 == 1]
    assert sum(got[i]["lang_pred"] == k for i, _, k, _ in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    marks = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ٣ _"), (3, "á")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for _, r in sorted(rows_of(language_id.identify(marks, known)).items())] == [True, True, False]
    assert language_id.learn(docs, F.lit(False)) == [] and {r.lang_pred for r in language_id.identify(docs, []).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), known).count() == 0


def test_narrow_margins_are_rejected_by_share(spark):
    rng = random.Random(9)
    lexicons = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(60)] for k, v in {"aa": ["th", "er", "on"], "bb": ["sch", "ei", "ung"], "cc": ["é", "eau", "que"]}.items()}
    made = [(k, speech(rng, lexicons[k], 80)) for i in range(300) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(made)], "doc_id long, text string, lang string")
    known = language_id.learn(docs, F.lit(True))
    assert 0 < known.least < 0.2
    noise = [(n * 100 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)), "") for n in (100, 500, 2000) for i in range(20)]
    short = [(i, speech(rng, lexicons[k], 6), k) for i in range(60) for k in [("aa", "bb", "cc")[i % 3]]]
    odd = spark.createDataFrame(noise, "doc_id long, text string, lang string")
    assert all(r.rejected for r in language_id.identify(odd, known).collect())
    got = rows_of(language_id.identify(spark.createDataFrame(short, "doc_id long, text string, lang string"), known))
    assert all(not r["rejected"] and r["lang_pred"] == r["lang"] for r in got.values())


# -- toxicity ---------------------------------------------------------------------------------


def toxic_rows(rng, n):
    clean, bad = ["lorem", "ipsum", "dolor", "amet", "you", "they"], ["zorgle", "idiot", "you"]
    made = []
    for i in range(n):
        y = int(i % 6 == 0)
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        for _ in range(2 * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad[:2]) + rng.choice(["", "ta", "mo"]))
        made.append((i, " ".join(words), y))
    return made


def test_toxicity(spark):
    data = toxic_rows(random.Random(4), 600)
    more = [(900, None), (901, ""), (902, LONG), (903, "YOU ZORGLEta idiot!!"), (903, "YOU ZORGLEta idiot!!")]
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in data] + [(i, t, 5) for i, t in more], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(0, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0, sample_rows=400)
    assert "zorgle-" in model.learned or "zorgl-" in model.learned
    got = rows_of(toxicity.score(docs, model))
    held = [r for r in data if r[0] % 5 == 0]
    assert sum(got[i]["predicted"] == y for i, _, y in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[903]["predicted"] == 1 and got[900]["score"] == got[901]["score"] and got[902]["predicted"] == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}


def test_isotonic_never_falls():
    import numpy as np

    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 4, 5, 6]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert list(np.diff(y) > 0) == [True] * (len(y) - 1) and list(np.diff(x) > 0) == [True] * (len(x) - 1)


# -- secrets ----------------------------------------------------------------------------------

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    n = Counter(k for _, k, _ in spans)
    return (n[0], n[1], n[2]), ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets_like_brute_force(spark):
    rng = random.Random(6)
    bits = ["token", "PassWord", "api_key", "APIKEY", "ſecret", "secret", ":", "=", ' = "', "'", " ", "\n", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "zzzzzzzzzzzz", "é", "-", "deadbeef", "K", "'"]
    data = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(900, None), (901, LONG), (902, "f" * 100_000)]
    got = rows_of(secrets.scan(spark.createDataFrame(data, "doc_id long, text string")))
    for i, text in data:
        n, base = brute_secrets(text)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (*n, hashlib.sha256(base.encode()).hexdigest()), text
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def literals(text):
    return [text[s.start : s.end] for s in secrets.literal_spans(text)]


def test_assignments_are_lexed():
    assert literals('db_password: "hunter2Xq9"') == ["hunter2Xq9"]
    assert literals('{"client_secret": "Zx81kQpL0", "name": "harmless words"}') == ["Zx81kQpL0"]
    assert literals('base = "Qw3rTy99Lk"\nlabel = "Zz81kQpL0"\nauth_token = base + "tAil77xQ"') == ["Qw3rTy99Lk", "tAil77xQ"]
    assert literals("note: the secret of life = patience") == []
    assert literals("x == y and password") == []


def test_tabs_long_gaps_and_types_are_lexed():
    assert literals('password\t=\t"Zx81kQpL0"') == ["Zx81kQpL0"]
    assert literals("password" + " " * 500 + '= "Zx81kQpL0"') == ["Zx81kQpL0"]
    assert literals("password_" + "of_a_long_name_" * 20 + 'x = "Zx81kQpL0"') == ["Zx81kQpL0"]
    for typed in ('password: str = "Zx81kQpL0"', 'let db_password: &str = "Zx81kQpL0"', 'const apiSecret: string = "Zx81kQpL0"', "const TOKEN: &'static str\t= \"Zx81kQpL0\"", 'token: Optional[Dict[str, str]] | None = "Zx81kQpL0"', 'secret: std::string = "Zx81kQpL0"'):
        assert literals(typed) == ["Zx81kQpL0"], typed
    assert literals('base: str = "Qw3rTy99Lk"\nauth_token: str = base\t+\t"tAil77xQ"')[-1:] == ["tAil77xQ"]
    assert literals('def f(password: str, label="Zz81kQpL0")') == []
    assert literals('token: see label = "Zz81kQpL0"') == []


def test_strings_comments_and_lines_are_lexed():
    assert literals('db_password = "Zx81\\"kQpL0"') == ['Zx81\\"kQpL0']
    assert literals('password = """Zx81kQpL0\nab9Q"""') == ["Zx81kQpL0\nab9Q"]
    assert literals("password = (\n  'Zx81kQpL0'\n  'Qw3rTy99Lk')") == ["Zx81kQpL0", "Qw3rTy99Lk"]
    assert literals("password = /* prod */ 'Zx81kQpL0'") == literals("# password = 'Zx81kQpL0'") == literals("/* password = 'Zx81kQpL0' */") == ["Zx81kQpL0"]
    assert literals("private_key: |\n  Zx81kQpL0aaQ\n  Qw3rTy99Lk\nname: Zx81kQpL0aaQ") == ["Zx81kQpL0aaQ", "Qw3rTy99Lk"]
    assert literals('password = os.environ["HOME_Zx81k"]') == literals("token = get('Zx81kQpL0')") == []
    assert literals("password = 'Zx81kQpL0' \\\n + `Qw3rTy99Lk`") == ["Zx81kQpL0", "Qw3rTy99Lk"]


def test_constants_like_a_brute_force_interpreter():
    rng = random.Random(12)
    for _ in range(200):
        values, lines, want = {}, [], set()
        for i in range(30):
            name = rng.choice(["a", "b", "c", "auth_token", "db_password"])
            parts = [rng.choice(["a", "b", "c", f'"Zx{rng.randint(10, 99)}kQ{i}pL"', f"'w0{i}Rt{rng.randint(10, 99)}Yq'"]) for _ in range(rng.randint(1, 3))]
            held = frozenset(x for p in parts for x in (values.get(p, {p} if p[0] in "abc" else {p[1:-1]})))
            values[name] = held
            if name in ("auth_token", "db_password"):
                want |= {x for x in held if len(x) > 1}
            lines.append(f"{name} = {' + '.join(parts)}")
        assert set(literals("\n".join(lines))) == want


def test_lexing_takes_linear_time():
    grown = 'x = "Zx81kQpL0"\n' + "x = x + x\n" * 10_000 + "password = x\n"
    assert literals(grown) == ["Zx81kQpL0"]
    for unit in ("a: 1\n", "a=", "a = /*", "a = '''", "k: |\n", "a: x<", "a = (((", "a = `", "a = // x\n", "= \""):
        times = []
        for n in (20_000, 160_000):
            start = time.process_time()
            secrets.literal_spans(unit * n)
            times.append(time.process_time() - start)
        assert times[1] < 24 * times[0] + 0.2, unit


def test_secret_edges(spark):
    docs = spark.createDataFrame([(1, 'password = "Zx81kQpL0"', "mine"), (1, 'password = "Zx81kQpL0"', "mine"), (None, None, None)], "doc_id long, text string, spans string")
    got = secrets.scan(docs)
    assert got.columns == ["doc_id", "text", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted((r.doc_id or 0, r.spans) for r in got.collect()) == [(0, "")] + [(1, "literal:12:21")] * 2
    assert secrets.scan(docs.limit(0)).count() == 0


# -- licenses ---------------------------------------------------------------------------------


def brute_words(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_phrases_like_brute_force(spark):
    rng = random.Random(7)
    bits = ["MIT", "mit", "License", "license", "apache", "General", "Public", " ", " ", "\n", "-", "_", "é", "😀", "x", "2", "licenses", "\x00"]
    data = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(900, None), (901, LONG), (902, "MIT License. " * 3000)]
    got = rows_of(license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")))
    for i, text in data:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_words(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_every_rule_passes_the_gate():
    for r in license_scan.rules():
        kw = r["kw"]
        assert any(g in r["re"].lower().replace("[cs]", "s").replace("\\s+", " ").replace("licens", "licens licen").replace("\\", "").replace("cc[ -]by", "cc by") for g in license_scan.GATE), r
        assert kw == kw.lower()


def samples(parsed):
    """Strings that a parsed pattern matches: every branch, with and without what is optional."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            each = [chr(arg)]
        elif name == "IN":
            each = [chr(v) if str(o) == "LITERAL" else {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "2", "CATEGORY_WORD": "x"}[str(v)] if str(o) == "CATEGORY" else chr(v[0]) for o, v in arg]
        elif name == "ANY":
            each = ["x"]
        elif name == "BRANCH":
            each = [x for branch in arg[1] for x in samples(branch)]
        elif name == "SUBPATTERN":
            each = samples(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            each = [x * n for n in sorted({arg[0], max(1, arg[0])}) for x in samples(arg[2])]
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT"), name
            each = [""]
        out = [a + b for a in out for b in dict.fromkeys(each)]
    return out


def test_every_alternative_passes_the_gate_and_its_keyword():
    parser = re._parser
    for r in license_scan.rules():
        own = r["re"].replace(license_scan.GRANTED, "licensed\\s+under\\s+")
        for text in samples(parser.parse(own)):
            assert re.search(r["re"], text), (r, text)
            low = text.lower()
            assert any(g in low for g in license_scan.GATE) and r["kw"] in re.sub(r"[\s-]+", " ", low), (r, text)


def test_rules_with_several_names(spark):
    texts = {1: "GNU Library General Public License version 2", 2: "Do What The Fuck You Want To Public License", 3: "GNU Free Documentation Licence", 4: "under WTFPL"}
    got = rows_of(license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: got[i]["labels"] for i in texts} == {1: "gpl,lgpl-2.1", 2: "wtfpl", 3: "gfdl", 4: "wtfpl"}
    assert [h["label"] for h in got[1]["hits"]] == ["lgpl-2.1"]


def test_rules(spark):
    texts = {
        1: "// SPDX-License-Identifier: Apache-2.0\n", 2: "Licensed under the Apache License, Version 2.0.", 3: "released under the terms of the GNU General Public License, version 3 or later", 4: "See https://opensource.org/licenses/MIT for details",
        10: "SPDX-License-Identifier: MIT OR Apache-2.0", 11: "SPDX-License-Identifier: (MIT AND BSD-3-Clause)", 12: "spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0",
        13: "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
        5: "CC BY-NC-SA 4.0", 6: "Copyright (c) 2020 Someone. All rights reserved.", 7: "Copyright (c) 2020, 3-Clause BSD License", 8: "mit dem Auto", 9: "GNU Lesser\n  General Public License v2.1",
    }
    got = rows_of(license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: got[i]["labels"] for i in texts} == {1: "apache-2.0", 2: "apache,apache-2.0", 3: "gpl,gpl-3.0", 4: "mit", 5: "cc-by-nc-sa-4.0", 6: "all-rights-reserved,copyright-notice", 7: "bsd-3-clause", 8: "", 9: "gpl,lgpl-2.1", 10: "apache-2.0,mit", 11: "bsd-3-clause,mit", 12: "gpl-2.0", 13: "mit"}
    assert [h.asDict() for h in got[2]["hits"]] == [{"label": "apache-2.0", "start": 0, "end": 46}]
    assert got[1]["score"] == 1.0 and got[6]["score"] == 0.5 and got[8]["score"] == 0.0
    assert len(license_scan.rules()) > 250 and license_scan.scan(spark.createDataFrame([], "doc_id long, text string, labels string")).count() == 0


# -- tool calls -------------------------------------------------------------------------------


def test_calls_are_linked(spark):
    messages = [
        (1, 0, "system", "be kind"), (1, 1, "user", 'a "b"\n'), (1, 2, "assistant", "c"), (1, 4, "assistant", "nobody asked"), (1, 5, "user", None),
        (2, 0, "user", "go"), (2, 1, "assistant", '{"tool_calls": [{"id": "b", "name": "add", "arguments": {"y": 2, "x": 1.50}, "after": ["a"]}, {"id": "a", "name": "add", "arguments": {"x": "no", "z": 1}}, {"id": "c", "name": "who"}]}'),
        (2, 2, "tool", '{"tool_call_id": "a", "content": {"v": 3, "k": [1, null]}}'), (2, 3, "tool", '{"tool_call_id": "zz", "content": "lost"}'), (2, 3, "tool", '{"tool_call_id": "a", "content": "again"}'),
        (3, 0, "assistant", '{"tool_calls": [{"id": "p", "name": "who", "after": ["q"]}, {"id": "q", "name": "who", "after": ["p"]}]}'),
    ]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    schemas = tool_calls.SCHEMAS | {"add": {"x": ("number", True), "y": ("integer", True)}}
    every = [r for r in tool_calls.link(df, schemas).collect()]
    assert [(r.status, r.json) for r in every if r.call_id == "a" and r.number == 2] == [("orphan result", '{"id":"a","result":"again"}')]
    got = {(r.conv_id, r.call_id): r for r in every if r.number == 1}
    assert {k: v.status for k, v in got.items()} == {(1, "turn:0"): "notice", (1, "turn:1"): "linked", (1, "turn:3"): "orphan result", (1, "turn:5"): "no result", (2, "turn:0"): "no result", (2, "b"): "no result", (2, "a"): "linked", (2, "c"): "no result", (2, "zz"): "orphan result", (3, "p"): "no result", (3, "q"): "no result"}
    assert got[1, "turn:1"].json == '{"arguments":{"text":"a \\"b\\"\\n"},"id":"turn:1","name":"reply","result":"c","turn":1}'
    assert got[2, "a"].json == '{"arguments":{"x":"no","z":1},"id":"a","name":"add","result":{"k":[1,null],"v":3},"turn":1}'
    assert got[2, "b"].json == '{"arguments":{"x":1.5,"y":2},"id":"b","name":"add","turn":1}'
    assert (got[2, "a"].errors, got[2, "b"].errors, got[2, "c"].errors, got[2, "a"].n_results) == ("missing y; unknown z; x is no number", "", "unknown function", 1)
    assert got[2, "a"].level < got[2, "b"].level and [got[3, x].level for x in "pq"] == [-1, -1]


def brute_levels(needs):
    """Level by id of {id: ids it depends on}; -1 on a cycle or behind one."""
    out, left, level = {}, dict(needs), 0
    while left:
        free = [x for x, ns in left.items() if not any(n in left for n in ns)]
        if not free:
            return out | dict.fromkeys(left, -1)
        out |= dict.fromkeys(free, level)
        left, level = {x: ns for x, ns in left.items() if x not in free}, level + 1
    return out


@pytest.mark.parametrize("most", [tool_calls.MOST, 3])
def test_calls_are_ordered_like_brute_force(spark, most):
    rng = random.Random(13)
    messages, want = [], {}
    for conv in range(20):
        names = [f"k{i}" for i in range(rng.randint(1, 12))]
        needs = {x: sorted({rng.choice([*names, "nobody"]) for _ in range(rng.choice([0, 0, 1, 2]))}) for x in names}
        turn = {x: i for i, x in enumerate(names)}
        messages += [(conv, turn[x], "assistant", json.dumps({"tool_calls": [{"id": x, "name": "f", "after": needs[x]}]})) for x in names]
        forward = any(n in turn and turn[n] >= turn[x] for x in names for n in needs[x])
        want |= {(conv, x): v if forward else 0 for x, v in brute_levels(needs).items()}
    messages += [(50, i, "assistant", json.dumps({"tool_calls": [{"id": f"k{i}", "name": "f", "after": [f"k{i + 1}"]}]})) for i in range(60)]  # one long chain
    want |= {(50, f"k{i}"): 59 - i for i in range(60)} if most > 60 else {}
    df = spark.createDataFrame([m for m in messages if m[0] != 50 or most > 60], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.call_id): r.level for r in tool_calls.link(df, most=most).collect()} == want


def test_no_message_is_lost(spark):
    rows = [(1, 1, "user", "first"), (1, 1, "user", "second"), (1, 2, "assistant", "r1"), (1, 2, "assistant", "r2"), (None, 1, "user", "a"), (None, 1, "user", "b"), (None, 2, "assistant", "c"), (2, 0, "user", LONG * 4), (2, 1, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, call_id string, number int")
    got = tool_calls.link(df).collect()
    said = sorted(t for r in got for t in ([json.loads(r.json)["arguments"]["text"]] if "arguments" in r.json[:14] else []) + ([json.loads(r.json)["result"]] if r.result_turn else []))
    assert said == sorted(r[3] for r in rows)
    assert [(r.number, json.loads(r.json)["arguments"]["text"], json.loads(r.json)["result"]) for r in sorted(got, key=lambda r: r.number) if r.conv_id == 1] == [(1, "first", "r1"), (2, "second", "r2")]


def test_calls_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tool_calls.link(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, 1, "user", "x"), (1, None, "user", "y"), (1, 1, None, "z"), (1, 2, "assistant", LONG), (1, 1, None, "z")], schema)
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(odd).collect()}
    assert got[1, "turn:1"].status == "linked" and got[1, "turn:1"].n_calls == 2 and got[None, "turn:1"].status == "no result" and len(got) == 3
