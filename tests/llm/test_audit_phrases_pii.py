"""Filter audit, collocations and personal data against brute force, on small frames with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from chatterlens.llm import collocations, filter_audit, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, spans string, part string, block string, kind string"


def frame(spark, rows, parts=3):
    wide = [(i, t, lang, "clash", "clash", None, "clash") for i, t, lang in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(parts, "text")


# --- filter audit -------------------------------------------------------------

def audit_rows():
    make = random.Random(3)
    long = " ".join(make.choice("abcdefgh") * make.randrange(1, 9) + str(make.randrange(30)) for _ in range(260))
    return [
        (1, long, "en"), (2, long, "en"), (3, long, None), (2, long, "en"), (None, long, "en"), (4, None, "en"),
        (5, "", "de"), (6, " \t\n", "de"), (7, "word " * 300, "de"), (8, "SHOUT " * 250, ""), (9, "a # b", "fr"),
        (10, "É é wide" * 3, "fr"), (11, "Word word WORD", "fr"), (None, None, None), (12, "x" * 70_000, "fr"),
        (13, "a # b", "en"), (14, long + " $", "en"), (0, "a # b", "de"),
    ]


def audit_labels():
    return [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (None, 1, 1), (99, 1, 1), (14, None, 0), (7, 0, 0)]


def failures(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        out = set()
        out |= {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        out |= {"E"} if i is not None and i > least[t] else set()
        yield i, lang or "", frozenset(out)


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    found = list(failures(rows))
    out = {}
    for part in {p for _, p, _ in found}:
        mine = [(i, f) for i, p, f in found if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for i, f in mine:
                first = next((c for c in order if c in f), None)
                shapley[first] += 1
        for order in permutations("ABCDE"):
            alive = mine
            for step, c in enumerate(order, 1):
                gone, left = [x for x in alive if c in x[1]], [x for x in alive if c not in x[1]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(c in f for _, f in mine) - len(gone), sum(f == {c} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), shapley[c])
                alive = left
    return out


def test_filter_audit(spark):
    labels = spark.createDataFrame(audit_labels(), "doc_id long, quality int, toxic int")
    found = filter_audit.audit(frame(spark, audit_rows()), labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in found} == brute_audit(
        audit_rows(), audit_labels())
    assert len(found) == 600 * len({lang or "" for *_, lang in audit_rows()})
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(empty, labels.limit(0)).count() == 0


def test_matrix_holds_every_word(spark):
    shards, dictionary, _ = filter_audit.matrix(frame(spark, audit_rows()))
    words = {r["term_id"]: bytes(r["word"]) for r in dictionary.collect()}
    expected = Counter()
    for _, t, _ in audit_rows():
        expected.update(w.encode() for w in WORD.findall(t or ""))
    assert len(set(words.values())) == len(words) == len(expected)
    total, texts = Counter(), Counter()
    for r in shards.collect():
        at, ids = filter_audit.unpress(r["indptr"], "<i8"), filter_audit.unpress(r["indices"], "<i8")
        counts = filter_audit.unpress(r["counts"], "<i4")
        for a, b in zip(at[:-1], at[1:]):
            row = {words[k]: int(n) for k, n in zip(ids[a:b].tolist(), counts[a:b])}
            total.update(row)
            texts[tuple(sorted(row.items()))] += 1
    assert total == expected
    assert texts == Counter(tuple(sorted(Counter(w.encode() for w in WORD.findall(t or "")).items())) for _, t, _ in audit_rows())


# --- collocations -------------------------------------------------------------

def phrase_rows():
    make = random.Random(9)
    common = ["new", "york", "Times", "san", "jose", "of", "the", "état", "a b"]
    def text():
        return "".join(make.choice(common) + make.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "-"]) for _ in range(60))
    rows = [(i, text() + (" new york times" * (i % 4)), make.choice(["en", "en", "en", None, "fr"])) for i in range(60)]
    return rows + [(61, None, "en"), (62, "", None), (63, ".,;", "xx"), (64, "solo", "yy"), (1, rows[1][1], "en"), (None, rows[2][1], "en")]


def brute_phrases(rows, support, percent, keep):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in candidates.items()):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("parts, support, percent, keep", [(1, 10, 50, 2000), (4, 10, 50, 2000), (7, 3, 80, 5)])
def test_collocations(spark, parts, support, percent, keep):
    found = collocations.mine(frame(spark, phrase_rows(), parts), support, percent, keep).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(phrase_rows(), support, percent, keep)
    assert len(found) > 5


def test_second_pass_counts_what_shards_hold_too_seldom(spark):
    """Five shards of equal size; the phrase is frequent in one and seldom in the others."""
    rows = [(i, "red fox. " * (6 if i == 0 else 1) + "filler %d. " % i * 40, "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartitionByRange(5, "doc_id")
    phrases, _, _ = collocations.frequent_phrases(docs, 10)
    assert {r["phrase"]: r["f"] for r in phrases.where("words = 2 AND phrase LIKE 'red%'").collect()} == {"red fox": 10}


def test_shards_cut_long_texts_between_pieces():
    text = b"one two. three four, " * 50
    runs = list(collocations.shards([b"a b", text, b"", b"c"], most=100))
    assert b"".join(x for run in runs for x in run) == b"a b" + text + b"c"
    assert all(sum(map(len, run)) <= 130 for run in runs)
    assert all(x.rstrip(b" ").endswith((b".", b",")) or x in (b"a b", b"", b"c", b" ") for run in runs for x in run)
    assert list(collocations.shards([b"x" * 500], most=100)) == [[b"x" * 500]]


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    found = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)], "lang string, words int, phrase string, f long")
    assert collocations.scored(found).first()["score"] == 10**6 * (big - 7) ** 2 // (big * (big - 1))


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0


# --- personal data ------------------------------------------------------------

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if fine else []
    return out


def spans_of(row):
    return [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["base"]]


def test_formats_on_random_strings(spark):
    make = random.Random(1)
    card = "4111111111111111"
    texts = ["".join(make.choice("0012345.@+ab_%- ()é😀\n") for _ in range(make.randrange(60))) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "a@b.c_d@e.f a@b a@b..c x@y.z.", f"{card} {card[:-1]}2 4111-1111 1111-1111",
              "9" * 30_000, "a." * 20_000 + "@b" + ".c" * 20_000, "+1" + " " * 30_000, "1." * 20_000, "+1 (509) 555-6973 +12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = pii.extract(docs, rounds=1).collect()
    assert len(found) == len(texts)
    for row in found:
        assert spans_of(row) == base_spans(texts[row["doc_id"]])


def context_rows():
    make = random.Random(4)
    rows = []
    for i in range(40):
        rows.append((i, f"Please call the desk: phone no. +1 (509) 555-{1000 + i} today.", "en"))
        rows.append((100 + i, f"write to mail: person{i}@site{i % 3}.example.com now", "en"))
        rows.append((200 + i, f"seen the {make.choice(['10.0.0.%d' % i, '+1 509 555 %d' % (2000 + i), str(1900 + i)])} again", "en"))
    return rows + [
        (301, "our phone no. (509) 555-7777, please", "en"), (302, "my phone no. 5095558888.", "en"),
        (303, "mail: josé@localhost", None), (304, "seen the 5095559999 again", "en"), (305, "phone no. 12", "en"),
        (306, "later 5095558888 again; mail: nobody", "en"), (307, None, "en"), (308, "", None),
        (302, "my phone no. 5095558888.", "en"), (None, "phone no. 509-555-6666", "en"),
    ]


def test_contexts_find_unseen_identifiers(spark):
    found = defaultdict(list)
    for row in pii.extract(frame(spark, context_rows())).collect():
        found[row["doc_id"]].append([(s["kind"], s["text"], s["base"]) for s in row["spans"]])
    texts = {(i, t or "") for i, t, _ in context_rows()}
    assert sum(map(len, found.values())) == len(context_rows())
    assert found[301] == [[("phone", "(509) 555-7777", False)]]
    assert found[302] == [[("phone", "5095558888", False)]] * 2
    assert found[303] == [[("email", "josé@localhost", False)]]
    assert found[306] == [[("phone", "5095558888", False)]]
    assert found[None] == [[("phone", "509-555-6666", False)]]
    assert found[304] == found[305] == found[307] == found[308] == [[]]
    for i, t in texts:
        if i is not None and i < 300:
            assert found[i] == [[(k, t[a:b], True) for k, a, b in base_spans(t)]]


def brute_known(events, rounds):
    """``events``: (patterns, instance, seed) triples."""
    links = {(p, inst, seed) for patterns, inst, seed in events for p in patterns}
    known = {}
    for _ in range(rounds):
        votes, total = defaultdict(float), Counter()
        for p, inst, seed in links:
            total[p] += 1
            if seed:
                votes[p, seed] += 1
            elif inst in known:
                votes[p, known[inst][0]] += known[inst][1]
        good = {(p, k): v / (total[p] + 1) for (p, k), v in votes.items()
                if total[p] >= pii.SUPPORT and v / (total[p] + 1) >= pii.CONFIDENT}
        rest = defaultdict(float)
        for p, inst, seed in links:
            for k in pii.KINDS:
                if not seed and (p, k) in good and fits(k, inst):
                    rest[inst, k] += math.log(1 - good[p, k])
        known = {}
        for (inst, k), v in sorted(rest.items(), key=lambda x: pii.KINDS.index(x[0][1])):
            score = 1 - math.exp(v)
            if score >= pii.ACCEPTED and (inst not in known or round(score, 9) > round(known[inst][1], 9)):
                known[inst] = (k, score)
    return known


def fits(kind, text):
    digits = len(re.sub("[^0-9]", "", text))
    shape, least, most = pii.SHAPES[kind]
    return re.match(shape.replace("\\x20", " "), text) is not None and least <= digits <= most


def test_graph_scores_against_brute_force(spark):
    make = random.Random(8)
    kinds = {"alpha": "phone", "beta": "card", "gamma": "email"}
    instances = [(str(make.randrange(10**9, 10**10)), None) for _ in range(9)]
    instances += [(f"+1{make.randrange(10**9)}", "phone") for _ in range(60)]
    instances += [(f"4{make.randrange(10**14, 10**15)}", make.choice([*["card"] * 9, None])) for _ in range(40)]
    instances += [(f"u{i}@h", None) for i in range(5)] + [(f"u{i}@h.com", "email") for i in range(30)]
    events = []
    for inst, seed in instances:
        for _ in range(make.randrange(1, 4)):
            word = make.choice([w for w, k in kinds.items() if k == seed] or ["alpha", "alpha", "gamma"]) if make.random() < 0.97 else make.choice(list(kinds))
            events.append(([f"2:the {word}", f"1:{word}", f"m:{word} _ {make.choice('xy')}"], inst, seed))
    links = {(p, i, s) for ps, i, s in events for p in ps}
    graph = spark.createDataFrame(
        [(p, i, s, [] if s else [k for k in pii.KINDS if fits(k, i)]) for p, i, s in links],
        "pattern string, instance string, seed string, fits array<string>")
    for rounds in (1, 3):
        found = {r["instance"]: (r["kind"], r["score"]) for r in pii.discover(graph, rounds)[0].collect()}
        expected = brute_known(events, rounds)
        assert set(found) == set(expected) and expected
        assert all(found[i][0] == k and abs(found[i][1] - s) < 1e-9 for i, (k, s) in expected.items())


def test_digest_and_empty(spark):
    rows = [(1, "a@b.co 10.0.0.1 +1 (509) 555-6973", "en"), (2, None, "en")]
    found = {r["doc_id"]: r for r in pii.digest(pii.extract(frame(spark, rows))).collect()}
    spans = "email:0:6,ip:7:15,phone:16:33"
    assert found[1]["spans"] == spans and found[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert (found[1]["n_email"], found[1]["n_ip"], found[1]["n_card"], found[1]["n_phone"]) == (1, 1, 0, 1)
    assert found[2]["spans"] == "" and found[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.digest(pii.extract(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_in_the_plan(spark):
    events = pii.located(pii.matches(frame(spark, context_rows())))
    plan = pii.edges(events)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
