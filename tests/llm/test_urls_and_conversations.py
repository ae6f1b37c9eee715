"""URL rules, the conversation trie and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graticule.llm import conversation_repair, conversation_trie, url_filter
from graticule.llm.common import materialise

RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("example.com", "/en", "allow"), ("net", "/es/", "block"), ("net", "/es/", "block"),
         ("net", "/es/", "allow"), (None, "/", "block"), ("org", None, "block"), ("net", "/x", None), ("deep.net", "/es/a/b/", "allow")]
URLS = ["http://www.EXAMPLE.com/en/1?x=/y", "https://example.com/en", "https://example.com/english#a", "ftp://a.example.com", "http://com/", "http://xcom/", "http://a.net/es/", "http://a.net/ES/", "http://deep.net/es/a/b/c",
        "http://x.deep.net/es/a//b/", "http://q.org?u=/", "no scheme /en/", "", None, "a://b://c.com/", "http://ünï.com/ü/é", "http://.com/", "http://a..net/es/", "http://net./es/", "http://a.net/es\n/", "http://a.net/" + "es/" * 3000]


def judged(page_id, url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p or ""), len(h), v == "block", h.lower() + (p or ""), v) for h, p, v in RULES if h is not None and v is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    best = max(fit, default=(None,) * 5)
    return page_id, host, path, best[3], best[4] or "allow"


@pytest.mark.parametrize("options", [{}, {"prefix": 1}, {"sent": 0, "salt": 3}, {"sent": 0, "salt": 1, "prefix": 1}])
def test_urls(spark, options):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], "x", "y"), (1, URLS[1], "x", "y"), (1, URLS[1], "x", "y")]
    urls = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([(*r, "z") for r in RULES], "host string, path string, verdict string, digest string")
    got = [tuple(r) for r in url_filter.judge(urls, rules, **options).collect()]
    assert sorted(got, key=repr) == sorted((judged(i, u) for i, u, *_ in rows), key=repr)


def test_urls_without_rules_or_rows(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judge(urls, rules, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert url_filter.judge(urls.where("false"), rules).collect() == []


def test_url_plan_has_no_python(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    for sent in (0, 10):
        plan = url_filter.judge(urls, spark.createDataFrame(RULES, "host string, path string, verdict string"), sent=sent)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TURNS = "conv_id long, turn long, role string, text string, n_convs int, path string"


def talks(seed, n):
    """Rows of n conversations that share turns, with copies, ties, nulls and long ones."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        size = draw.choice([1, 2, 2, 3, 4, 5, 6, 9]) if c != 7 else 300
        kind = draw.choice([0, 0, 0, 1, 2])
        for t in range(size):
            role = ["user", "assistant"][t % 2] if kind else draw.choice(["user", "assistant", "system", None, "", "tool"])
            text = {0: draw.choice(["a", "b.", "ü🙂!", None, "", "  ", "c? \n"]), 1: f"same {t}.", 2: f"same {min(t, 3)}."}[kind]
            rows.append((c if c != 11 else None, t if draw.random() > 0.1 else draw.choice([None, 0]), role, text))
    rows += [rows[0], rows[0], rows[5]]
    return [(*r, 1, "x") for r in rows]


def turn_key(row):
    role, text = row[2], row[3]
    return row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows):
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append((r[0], r[1], r[2] or "", r[3] or ""))
    own = {c: [x[2:] for x in sorted(v, key=turn_key)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        seqs[c] = tuple((own.get(c - c % 100, [])[:h] if h else []) + turns[h:])
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    least = lambda m: min((c for c in m if c is not None), default=None)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if c is not None and len(seqs[c]) == len(p)))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((least(m), len(p), least(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed, parts, run_bytes", [(1, 1, 1 << 20), (2, 4, 1 << 20), (3, 7, 700), (4, 23, 1), (5, 1, 1)])
def test_trie(spark, seed, parts, run_bytes):
    rows = talks(seed, 60) + [(200 + c, t, "user", f"hot {t}", 1, "x") for c in range(80) for t in range(6)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = conversation_trie.sequences(spark.createDataFrame(rows, TURNS))
        got = [tuple(r) for r in conversation_trie.trie(conversation_trie.rebuilt(own), run_bytes).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=repr) == sorted(brute_trie(rows), key=repr)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(none))).collect() == []


def test_merge_compares_from_the_lcp_on():
    draw = random.Random(0)
    turn = lambda x: x.to_bytes(conversation_trie.TURN, "big")
    rows = [(i if i % 9 else None, b"".join(turn(draw.randrange(2)) for _ in range(draw.randrange(9))), []) for i in range(500)]
    for k in (1, 2, 3, 5, 8, 13):
        runs = [conversation_trie.sorted_run(rows[i::k]) for i in range(k)]
        assert list(conversation_trie.merged(runs)) == list(conversation_trie.sorted_run(rows))


def brute_edits(codes):
    """All edits tried one after the other."""
    allowed = {("^", "s"), ("^", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    paths = {("^", 0, "")}
    for c in codes:
        fault, own = c >> 2, "?sua"[c & 3]
        more = set()
        for x, cost, audit in paths:
            for n in range(3):  # inserts before the row
                y = x
                for _ in range(n):
                    y = "a" if y == "u" else "u"
                so_far = cost + 2 * n, audit + "I" * n
                more.add((y, so_far[0] + 3, so_far[1] + "D"))
                if fault < 2:
                    if (y, own) in allowed:
                        more.add((own, so_far[0] + (fault == 1), so_far[1] + "K"))
                    z = "a" if y == "u" else "u"
                    more.add((z, so_far[0] + 2 + (fault == 1), so_far[1] + "R"))
        paths = more
    ends = []
    for x, cost, audit in paths:
        n = {"^": 0, "a": 0, "u": 1, "s": 2}[x]
        ends.append((cost + 2 * n, audit + "I" * n))
    return min(ends)


def test_edits_are_the_cheapest_and_least():
    draw = random.Random(0)
    for n in range(5):
        for codes in itertools.product(range(16), repeat=n) if n < 3 else [[draw.randrange(16) for _ in range(n)] for _ in range(150)]:
            assert conversation_repair.edits(bytes(codes)) == brute_edits(codes), codes
    long = bytes(draw.randrange(16) for _ in range(200_000))
    cost, audit = conversation_repair.edits(long)
    assert len(audit) - audit.count("I") == len(long) and cost >= 2 * audit.count("R")


def brute_repair(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else text.translate(str.maketrans("", "", ".!?")) if f == 2 else text
        own[c] += [(c, t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    out = []
    for c, turns in own.items():
        turns = sorted(turns, key=turn_key)
        seen, codes = set(), []
        for _, _, role, text in turns:
            body = text.strip(conversation_repair.SPACE)
            fault = 3 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            seen.add((role, text))
            codes.append(4 * fault + "?sua".index(role[0] if role[:1] in tuple("sua") else "?"))
        known = [t for _, t, *_ in turns if t is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = conversation_repair.edits(bytes(codes))
        text = "\n".join(f"{r}:{t}" for r, t in conversation_repair.repair(audit, iter([x[2:] for x in turns])))
        n = lambda k: sum(x >> 2 == k for x in codes)
        out.append((c, max(known) - min(known) + 1 - len(set(known)) if known else 0, n(3), n(2), n(1), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    raw = talks(seed, 80) + [(500, t, "user", "hot", 1, "x") for t in range(300)] + [(501, 3, "user", "hot", 1, "x")] * 50
    rows = conversation_repair.damaged(spark.createDataFrame(raw, TURNS))
    plans = materialise(conversation_repair.plan(rows), "plans")
    got = [tuple(r) for r in conversation_repair.digests(rows, plans).collect()]
    want = brute_repair(raw)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    turns = conversation_repair.repaired(rows, plans).orderBy("conv_id", "place").collect()
    texts = defaultdict(list)
    for r in turns:
        assert r.place == len(texts[r.conv_id])
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(texts[w[0]]).encode()).hexdigest() == w[-1] for w in want)
    for own in texts.values():
        roles = "".join(t[0] for t in own)
        assert roles.removeprefix("s") == "ua" * (len(own) // 2)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    plans = conversation_repair.plan(none)
    assert plans.collect() == [] and conversation_repair.digests(none, plans).collect() == [] and conversation_repair.repaired(none, plans).collect() == []
    dropped = spark.createDataFrame([(9, 1, "user", "x", 0)], "conv_id long, turn long, role string, text string, times int")
    plans = conversation_repair.plan(dropped)
    assert [tuple(r) for r in conversation_repair.digests(dropped, plans).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_queries_equal_their_sql(spark):
    import duckdb

    from graticule.llm import registry

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("op11_url_filter", "op12_conversation_trie", "op13_conversation_repair"):
        df = registry.queries()[name](spark, folder)
        columns = sorted(df.columns)
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))
        assert df.select(*(F.col(c) for c in columns)).count() == len(want)
