"""URL rules, conversation repair and vector codes against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafspark.llm import convrepair, rules, urlrules, veccodes

# ---- op11

PAGES = "page_id long, url string, html string, tokens string, host int, verdict int, items int, n_rows int"


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h", "t", 1, 2, 3, 4) for i, u in enumerate(urls)], PAGES)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


ODD_URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x", "http://example.net/en", "http://example.net", "http://notexample.net/EN/",
    "ftp://x.org/fr/?a=1#f", "http://org/fr/", "http://net?x", "://net/", "http://É.net/a b", "http://example.com/de/#://net/",
    "a://b://c.net/", "http://net:80/", "http://x.net/\n/y", "http://" + "a." * 5_000 + "net/", "http://q.net/" + "s/" * 20_000, "http:///en/",
]


def test_url_parts_and_policy(spark):
    found = {r.page_id: r for r in urlrules.judge_urls(pages_of(spark, ODD_URLS)).collect()}
    assert len(found) == len(ODD_URLS)
    for i, url in enumerate(ODD_URLS):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule), url
        assert found[i].verdict == (verdict or found[i].verdict) and found[i].verdict in ("allow", "block")


def plain_mining(labelled, tokens, support, confidence):
    counts, sources = Counter(), defaultdict(set)
    for url, verdict, source in labelled:
        for n in range(1, len(tokens[url]) + 1):
            for items in itertools.combinations(sorted(tokens[url]), n):
                counts[items, verdict] += 1
                sources[items, verdict].add(source)
    least = math.ceil(support * len(labelled))
    whole = Counter()
    for (items, _), n in counts.items():
        whole[items] += n
    rules = {k: n / whole[k[0]] for k, n in counts.items() if n >= least and n / whole[k[0]] >= confidence and len(sources[k]) > 1}
    return {
        k: c for k, c in rules.items()
        if not any(rules.get((tuple(x for x in k[0] if x != gone), k[1]), -1) >= c for gone in k[0])
    }


def test_mined_rules_are_those_of_brute_force(spark):
    rng = random.Random(5)
    hosts, parts, keys = ["a.com", "b.com", "c.de"], ["en", "de", "shop", "7"], ["id", "ref"]
    labelled = []
    for _ in range(400):
        url = f"http://{rng.choice(hosts)}/{rng.choice(parts)}/{rng.choice(parts)}?{rng.choice(keys)}=1"
        bad = "shop" in url and ("ref" in url or rng.random() < 0.2)
        labelled.append((url, "block" if bad else "allow", f"r{rng.randrange(2)}"))
    labelled += [("http://x.y/z", None, "r0"), (None, "allow", "r1"), (None, "block", "r1")]
    frame = spark.createDataFrame(labelled, "url string, verdict string, source string").repartition(3)
    seen = frame.select("url", urlrules.url_tokens(F.col("url")).alias("t")).distinct().collect()
    tokens = {r.url: r.t or [] for r in seen}
    used = [r for r in labelled if r[1] and tokens[r[0]]]
    want = plain_mining(used, tokens, 1 / 16, 0.75)
    for run in (12, 3):
        got = {(tuple(r.items), r.verdict): r.confidence for r in urlrules.mine_rules(frame, 1 / 16, 0.75, run).collect()}
        # Shorter runs find fewer combinations, never other ones.
        assert got == want if run == 12 else got.items() <= want.items()
    assert any(len(items) > 1 for items, _ in want)


def test_hot_and_repeated_urls_and_empty_tables(spark):
    urls = ["http://x.example.net/en/1"] * 300 + ["http://y.example.net/de/2", "http://y.example.com/de/2"] * 20 + ["http://z.com/de/5"] * 200
    got = urlrules.judge_urls(pages_of(spark, urls)).groupBy("rule", "verdict").count().collect()
    assert {(r.rule, r.verdict): r["count"] for r in got} == {("example.net/en/", "allow"): 300, ("net/", "block"): 20, ("example.com/de/", "block"): 20, (None, "block"): 200}
    assert urlrules.judge_urls(pages_of(spark, [])).count() == 0
    assert {r.verdict for r in urlrules.judge_urls(pages_of(spark, ["http://z.com/de/5", None])).collect()} == {"allow"}


# ---- op12

TURNS = "conv_id long, turn long, role string, text string, part int, seg int, hash int, copies int"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Least (cost, audit, lines) by trying all edits, state by state."""
    seen, symbols = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        symbols.append(fault)
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def inserted(states):
        for _ in range(2):
            for q, (cost, audit, lines) in list(states.items()):
                kind = "a" if q == 2 else "u"
                to = step[kind][q]
                new = (cost + 5, audit + "I", (*lines, ("assistant:" if kind == "a" else "user:")))
                states[to] = min(states.get(to, new), new)
        return states

    states = {0: (0, "", ())}
    for (role, text), fault in zip(rows, symbols):
        after = {}
        for q, (cost, audit, lines) in inserted(states).items():
            options = [(q, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if q in step.get(role[:1], {}):
                    options.append((step[role[:1]][q], (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                for kind, name in (("u", "user"), ("a", "assistant")):
                    if q in step[kind]:
                        options.append((step[kind][q], (cost + 1 + extra, audit + "R", (*lines, f"{name}:{text}"))))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        states = after
    states = inserted(states)
    cost, audit, lines = min(states[q] for q in (0, 3) if q in states)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), Counter(symbols)


def plain_conversations(rows):
    convs = defaultdict(list)
    for row in rows:
        convs[row[0]]
    for conv, turn, role, text in plain_damage(rows):
        convs[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: r[:4])
        turns = [t for known, t, *_ in found if known]
        initials = [r[2][:1] for r in found]
        cost, audit, digest, faults = plain_repair([(r[2], r[4]) for r in found])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def made_turns(seed, n, conv_ids):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "Ok?", "", " \n", None, "a:b.", "é.", "Yes. \t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent", "User"]
    return [(rng.choice(conv_ids), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) or rng.choice(["Long one %d." % rng.randrange(99), None, ""])) for _ in range(n)]


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS)


@pytest.mark.parametrize(("segment", "sent"), [(256, 100_000), (3, 0), (1, 100_000)])
def test_repairs_are_those_of_brute_force(spark, segment, sent, monkeypatch):
    monkeypatch.setattr(convrepair, "BROADCAST_REPEATS", sent)
    rows = made_turns(1, 600, [None, *range(60)]) + made_turns(2, 500, [1000]) + [(2000, 1, "user", "x" * 200_000 + "."), (2000, 2, "assistant", "y.")]
    got = convrepair.repair_conversations(convrepair.damage(turns_of(spark, rows).repartition(5)), segment).collect()
    want = plain_conversations(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_dropped_conversations_and_empty_tables(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:5".encode()) % 20 == 0)
    got = convrepair.repair_conversations(convrepair.damage(turns_of(spark, [(lost, 5, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert convrepair.repair_conversations(convrepair.damage(turns_of(spark, []))).count() == 0


def test_any_grammar_gives_the_same_repair():
    rng = random.Random(3)
    rules = [("u", "a"), ("Ā", "Ā"), ("x", "u"), ("ā", "ā"), ("a", "a")]
    plain, clever = convrepair.Grammar([]), convrepair.Grammar(rules)
    for _ in range(300):
        symbols = "".join(rng.choice("xsuaoSUAOuaua") for _ in range(rng.randrange(40)))
        assert plain.repair(symbols) == clever.repair(symbols)
        vector = convrepair.product([[(0, ""), None, None, None]], clever.transfer(symbols))
        assert clever.finish(vector) == plain.repair(symbols)


def test_grammar_is_learnt_from_frequent_pairs(spark):
    rows = spark.createDataFrame([("uauauaua",)] * 50 + [("suaua",)] * 20 + [("",), ("x",)], "symbols string").repartition(3)
    rules = convrepair.learn_grammar(rows)
    assert rules[0] == ("u", "a") and len(convrepair.Grammar(rules).compress("uauauaua")) == 1
    assert convrepair.learn_grammar(rows.where("symbols = ''")) == []


# ---- op13

VECTORS = "vec_id long, embedding array<double>, label int, code string, n int, ids int, words int"


def plain_codes(rows, rounds=6, entries=16, parts=8):
    kept = [(i, [float(x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    ints = [[math.floor(x * 4096) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = {}
    for (i, v, _), row in sorted(zip(kept, ints), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][1])):
        order.setdefault(i, row)
    w = width // parts
    books = [[row[p * w : (p + 1) * w] for row in list(order.values())[:entries]] for p in range(parts)]

    def near(p, row):
        piece = row[p * w : (p + 1) * w]
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for row in ints:
                groups[near(p, row)[1]].append(row[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(p, row) for p in range(parts)] for row in ints]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return sorted(
        ((i is None, i or 0, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors))
    )


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], VECTORS)


def made_vectors(n, width, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, width))
    return [(int(i * 7 % n), (centres[i % 5] + rng.normal(0, 0.05, width)).tolist(), None if i % 4 == 0 else int(i % 3)) for i in range(n)]


ODD_VECTORS = [(None, [0.5] * 16, None), (5, None, 1), (6, [1.0, None] * 8, 1), (7, [float("nan")] * 16, 2), (8, [float("-inf")] * 16, 2), (3, [], 1), (2, [-0.1] * 3, 1), (2, [-0.2] * 3, 1), (2, [-0.2] * 3, 1), (900, [0.25] * 19, 0)]


@pytest.mark.parametrize("rows", [made_vectors(300, 16), made_vectors(60, 16) + ODD_VECTORS, ODD_VECTORS, [(1, [], None)], []])
def test_codes_are_those_of_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(veccodes, "SLICE_ROWS", 37)
    got = veccodes.compress(vectors_of(spark, rows).repartition(3)).collect()
    found = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got)
    assert found == plain_codes(rows)


def test_huge_components_saturate(spark):
    rows = [(1, [1e300] * 8, 0), (2, [-1e300] * 8, 0), (3, [0.0] * 8, 0)]
    got = veccodes.compress(vectors_of(spark, rows)).collect()
    assert len(got) == 3 and all(r.error == 0 and r.label_error == 0 for r in got)


def test_dictionaries_give_the_values_back():
    import pyarrow as pa

    shape = veccodes.Shape(8)
    grid = veccodes.integers(pa.array([[0.1, -0.1], [1.0] * 8, []], pa.list_(pa.float64())), shape)
    assert grid.tolist() == [[409, -410] + [0] * 6, [4096] * 8, [0] * 8]


def test_ledger_measures_few_texts_at_a_time(spark):
    """A batch of long texts leaves in several; every row once."""

    class Rows:
        schema = T.StructType([T.StructField("doc_id", T.LongType())])

        def select(self, *columns):
            return self

        def mapInArrow(self, function, columns):
            self.measure = function
            return self

        def withColumn(self, name, value):
            return self

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": ["one two three\n" * 30_000] * 6})
    found = list(rules.ledger(Rows()).measure(iter([batch])))
    assert len(found) == 6
    assert [(i, n) for b in found for i, n in zip(b.column("doc_id").to_pylist(), b.column("n_words").to_pylist())] == [(i, 90_000) for i in range(6)]
