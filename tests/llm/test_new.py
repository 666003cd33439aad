"""Chat formatting, ranked lexical search and the prefix trie against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import chat_format, lexical_search, near_dedup, prefix_trie, turns

CONV = "conv_id long, turn long, role string, text string, at long, node string, message string, kind string"
EVENT = "conv_id long, seq long, kind string, message long, role string, text string"


@pytest.fixture(scope="module")
def conversations(spark):
    """Copies, shared beginnings, one long conversation, nulls in every column, repeated rows, clashing column names."""
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None, "tool"]), rng.choice(["a", "b", "", None, "</s>[INST] x"])) for c in range(0, 260) if c % 7 for t in range(rng.randrange(1, 7))]
    rows += [(100, t, "user", "same") for t in range(4)] + [(c, t, "user", "same") for c in (101, 102, 103, 500, 501, 900) for t in range(4)]
    rows += [(700, t, "assistant", f"w{t % 3}" * 50) for t in range(400)] + [(701, t, "assistant", f"w{t % 3}" * 50) for t in range(300)]
    rows += [(5, None, "user", "first"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (None, 1, "user", "no id"), (-3, 0, "user", "é\U0001f642"), (-103, 2, None, None)]
    return spark.createDataFrame([(*r, 1, "n", "m", "k") for r in rows], CONV).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CONV)


def by_conversation(df, tie=None):
    """Turns of each conversation as the operators order them: by turn, then by a hash."""
    own = df.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))).withColumn("h", F.expr(tie or "xxhash64(role, text)"))
    out = defaultdict(list)
    for r in sorted(own.collect(), key=lambda r: (-1 if r.turn is None else r.turn, r.h)):
        out[r.conv_id].append((r.role, r.text))
    return out


# turns


def test_positions_of_a_conversation_in_many_ranges(spark):
    own = spark.range(5000).selectExpr("if(id % 3 = 0, 1, id) as k", "id * 7919 % 5003 as t").unionByName(spark.range(300).selectExpr("1L as k", "0L as t"))
    found, sizes = turns.positions(turns.ordered(own, F.col("k"), F.col("t")), "k")
    got = defaultdict(list)
    for r in found.collect():
        got[r.k].append((r.position, r.t))
    for k, rows in got.items():
        rows.sort()
        assert [p for p, _ in rows] == list(range(len(rows))) and [t for _, t in rows] == sorted(t for _, t in rows)
    assert {r.k: r.n for r in sizes.collect()} == {k: len(v) for k, v in got.items()}


# 11 chat formatting


def folded(events):
    """The rules, event by event: (conv_id, message) -> role, text."""
    out, seen = {}, set()
    for conv, seq, kind, message, role, text in sorted(events, key=lambda e: (e[1], e[2], e[3])):
        if (conv, seq) in seen:
            continue
        seen.add((conv, seq))
        if kind == "regenerate":
            for key in [k for k in out if k[0] == conv and k[1] >= message]:
                del out[key]
        if kind in ("open", "regenerate"):
            out[conv, message] = [role or "", ""]
        elif (conv, message) in out:
            out[conv, message][1] = (text or "") if kind == "edit" else out[conv, message][1] + (text or "")
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize(("slice_size", "held"), [(1 << 16, 1 << 22), (8, 1 << 22), (16, 6), (1, 1)])
def test_folds_in_slices(spark, slice_size, held):
    rng = random.Random(11)
    events = []
    for conv in (1, 2, None):
        for seq in range(-5, 220):
            kind = rng.choices(chat_format.KINDS, [4, 8, 2, 1])[0]
            events.append((conv, seq, kind, rng.randrange(8), rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "", None])))
    again = [e for e in events if e[1] % 5 == 0]
    bad = [(1, None, "open", 1, "user", ""), (1, 3000, "close", 1, "user", ""), (1, 3001, "delta", None, "user", "lost")]
    log = spark.createDataFrame(events + again + bad, EVENT).repartition(7)
    found = {(r.conv_id, r.message): (r.role, r.text) for r in chat_format.messages(log, slice_size, held).collect()}
    assert found == folded(events)


def test_log_folds_to_the_conversations(spark, conversations):
    log = chat_format.event_log(conversations)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == set(chat_format.KINDS) and log.count() > log.select("conv_id", "seq").distinct().count()
    found = defaultdict(list)
    for r in chat_format.messages(log).orderBy("conv_id", "message").collect():
        found[r.conv_id].append((r.role, r.text))
    assert found == by_conversation(conversations)


def test_control_strings_are_escaped(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST] <\\s>", "[[INST]<<s>", "[/SYS][SYS][OUT][ROLE][TEXT]", "plain \\ [x] <b>", "", "</s", "[", "é</s>\n"]
    rows = [(k, m, role, x) for k, x in enumerate(hard) for m, role in enumerate(("user", "assistant", "system", "[TEXT] odd </s>", ""))]
    rendered = chat_format.render(spark.createDataFrame(rows, "conv_id long, message long, role string, text string")).collect()
    assert len(rendered) == len(rows)
    marks = re.compile(r"\[/?(?:INST|SYS)\]|\[(?:OUT|ROLE|TEXT)\]|</?s>")
    for r in rendered:
        role, text = rows[r.conv_id * 5 + r.message][2:]
        assert chat_format.parse_turn(r.formatted) == (role, text)
        assert len(marks.findall(r.formatted)) == (3 if role not in chat_format.MARKS else 2)
        assert (r.loss_start is None) == (role != "assistant")
        if role == "assistant":
            assert chat_format.unescape(r.formatted[r.loss_start : r.loss_end]) == text
    with pytest.raises(ValueError):
        chat_format.parse_turn("[INST] a [/INST] b [/INST]")


def test_read_back(spark, conversations, none, tmp_path):
    want = {}
    for c, rows in by_conversation(conversations).items():
        said = "".join(t for r, t in rows if r == "assistant")
        want[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    rendered = chat_format.render(chat_format.messages(chat_format.event_log(conversations)))
    chat_format.write_chats(rendered, f"{tmp_path}/chats")
    found = chat_format.read_back(spark.read.parquet(f"{tmp_path}/chats")).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == want
    lengths = Counter()
    for r in rendered.collect():
        lengths[r.conv_id] += len(r.formatted)
    assert {r.conv_id: r.formatted_chars for r in found} == lengths
    assert chat_format.read_back(chat_format.render(chat_format.messages(chat_format.event_log(none)))).count() == 0


# 12 ranked lexical search


def ranked(docs, items, k):
    words = lambda x: [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")]
    LOWER = {c: c + 32 for c in range(65, 91)}
    own = [(d, Counter(words(x))) for d, x in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_words = len(own), sum(sum(c.values()) for _, c in own)
    df, wanted, out = Counter(w for _, c in own for w in c), defaultdict(set), set()
    for i, x in items:
        wanted[i] |= set(words(x))
    for i, terms in wanted.items():
        scored = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            if s > 0:
                scored.append((-s, math.inf if d is None else d, d))
        out |= {(i, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)}
    return out


@pytest.mark.parametrize(("k", "terms", "postings"), [(10, 1 << 18, 1 << 22), (3, 12, 1), (1, 1, 50)])
def test_search(spark, monkeypatch, k, terms, postings):
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(30)] + ["é", "Ünï"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice([w, w.upper()]) for w in rng.choices(vocabulary, range(1, 33), k=n))
    docs = [(d, text(rng.randrange(1, 40))) for d in range(300)] + [(1000 + d, "w3 w4 common copy w4") for d in range(60)] + [(None, "w3 w4"), (7, "w1 w1"), (7, "w1 w1"), (8, None), (9, ""), (10, " .,"), (11, "w5 " * 30_000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(3, "w2 again"), (50, None), (51, ""), (52, "unheard"), (None, "w1")]
    found = lexical_search.search(
        spark.createDataFrame([(*r, 1, "x", "y") for r in docs], "doc_id long, text string, rank int, score string, vector string").repartition(6),
        spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string"), k, terms,
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in found.collect()} == ranked(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == [("i", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 1800))]
    with pytest.raises(ValueError):
        lexical_search.search(docs, items, 0)


def test_equal_bags_are_scored_once(spark, monkeypatch):
    """Copies and rearrangements are one class; at most k of its members leave a task."""
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 2 = 0, 'cat dog other', 'other, DOG cat') as text").unionByName(spark.createDataFrame([(9000, "cat cat dog")], "doc_id long, text string"))
    docs = docs.unionByName(spark.range(10_000, 15_000).selectExpr("id as doc_id", "'nothing of it' as text"))
    items = spark.createDataFrame([(1, "cat dog"), (2, "dog bird")], "item_id long, text string")
    found = [tuple(r)[:3] for r in lexical_search.search(docs, items, 4).orderBy("item_id", "rank").collect()]
    assert found == [(1, 1, 9000), (1, 2, 0), (1, 3, 1), (1, 4, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]


# 13 prefix trie


TIE = "md5(concat(char_length(role), ':', role, text))"


def brute_trie(turns_of):
    nodes = defaultdict(list)
    for c, rows in turns_of.items():
        for d in range(len(rows) + 1):
            nodes[tuple(rows[:d])].append(c)
    kids = defaultdict(list)
    for seq in nodes:
        if seq:
            kids[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(nodes, key=len, reverse=True):
        leaves[seq] = sum(leaves[x] for x in kids[seq]) if kids[seq] else 1
        saved[seq] = (len(nodes[seq]) - 1) * (len(seq[-1][1]) if seq else 0) + sum(saved[x] for x in kids[seq])
    out = set()
    for seq, members in nodes.items():
        own = ",".join(str(c) for c in sorted(members) if len(turns_of[c]) == len(seq))
        out.add((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids[seq]), leaves[seq], saved[seq], hashlib.sha256(own.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("block", "run", "rows", "few"), [(1 << 16, 4096, 1 << 17, 10_000), (40, 7, 64, 10_000), (300, 64, 1, 0)])
def test_trie(conversations, monkeypatch, block, run, rows, few):
    for name, value in (("RUN", run), ("ROWS", rows), ("FEW", few), ("PIECE", 3)):
        monkeypatch.setattr(prefix_trie, name, value)
    order = by_conversation(conversations.where("conv_id is not null"), TIE)
    again = {}
    for c, turns_of in order.items():
        first = c - int(math.fmod(c, 100))
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = order.get(first, [])[:h] + turns_of[h:]
    found = prefix_trie.trie(*prefix_trie.rebuilt(conversations), block).collect()
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == brute_trie(again)
    assert any(not x for x in again.values())


def test_trie_of_conversations_as_they_are(conversations, none):
    found = prefix_trie.trie(*prefix_trie.originals(conversations), 100).collect()
    assert {tuple(r) for r in found} == brute_trie(by_conversation(conversations.where("conv_id is not null"), TIE))
    assert prefix_trie.trie(*prefix_trie.rebuilt(none)).count() == 0


def test_centroid_sums():
    rng = np.random.default_rng(5)
    for n, deep in ((1, 0), (50, 0), (300, 0.9), (300, 1)):
        parent = np.array([-1 if v == 0 or rng.random() < 0.02 and deep < 1 else (v - 1 if rng.random() < deep else int(rng.integers(v))) for v in range(n)])
        values = rng.integers(0, 1000, (n, 2))
        weight, want = rng.integers(1, 5, n), values.copy()
        for v in range(n - 1, 0, -1):
            if parent[v] >= 0:
                weight[parent[v]] += weight[v]
                want[parent[v]] += want[v]
        assert (prefix_trie.centroid_sums(parent, weight, values) == want).all()


# 10 near duplicates: look-alikes


def alike(core, tail, k, name):
    return " ".join([*(f"{name}{j}" for j in range(core)), *(f"{name}{k}t{j}" for j in range(tail))])


def test_look_alikes_put_out_nothing(spark, monkeypatch):
    """Hundreds of texts at 0.72 of each other: no link leaves a block, and their texts are read in proportion to their number."""
    seen = []
    real = near_dedup.connected_components
    monkeypatch.setattr(near_dedup, "connected_components", lambda links: seen.append(links.count()) or real(links))
    own = spark.createDataFrame([(k, alike(400, 77, k, "w")) for k in range(300)], "doc_id long, text string").repartition(4)
    found = near_dedup.near_duplicates(own).collect()
    assert len({r.component_id for r in found}) == 300 and all(r.kept for r in found) and seen == [0]


@pytest.mark.parametrize(("block", "shingles"), [(4096, 1 << 21), (16, 1 << 21), (4096, 3000)])
def test_links_across_components(spark, monkeypatch, block, shingles):
    """Families just above and below the line, in one block and in many, against all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SHINGLES", shingles)
    rng = random.Random(2)
    texts = [alike(150, 29, k, "low") for k in range(40)] + [alike(150, rng.choice([23, 24, 26, 27]), k, "high") for k in range(60)]
    texts += [" ".join(f"c{j + k * 12}" for j in range(200)) for k in range(20)]  # a chain: neighbours are linked, others aren't
    sets = list(near_dedup.shingles([t.encode() for t in texts]))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: find(k) for k in range(len(texts))}


def test_spanning_links():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(80)]
    comp, block = np.arange(80) // 3, np.arange(80) % 2
    for between in (False, True):
        out = near_dedup.spanning_links(sets, block, comp, np.arange(80), between)
        links = {(x, y) for x in range(80) for y in range(x) if comp[x] != comp[y] and (not between or block[x] != block[y]) and 100 * len(np.intersect1d(sets[x], sets[y])) >= 75 * len(np.union1d(sets[x], sets[y]))}

        def classes(pairs):
            own = {int(c): int(c) for c in comp}
            for a, b in pairs:
                a, b = own[int(comp[a])], own[int(comp[b])]
                own = {k: a if v == b else v for k, v in own.items()}
            return {frozenset(k for k in own if own[k] == v) for v in own.values()}

        assert set(out) <= links and classes(out) == classes(links) and len(out) == 27 - len(classes(links))


def test_only_texts_of_named_documents_are_shuffled(spark, monkeypatch):
    """Few members of blocks that may be linked: a broadcast of their ids picks their documents; the links are those of the other way."""
    rng = random.Random(2)
    texts = [alike(150, 29, k, "low") for k in range(40)] + [alike(150, rng.choice([23, 24, 26, 27]), k, "high") for k in range(60)]
    own = spark.createDataFrame(list(enumerate(texts + [" ".join(f"c{j + k * 12}" for j in range(200)) for k in range(20)])), "doc_id long, text string")
    real, plans, found = near_dedup.cut, [], {}
    monkeypatch.setattr(near_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    for few in (-1, 1 << 20):
        monkeypatch.setattr(near_dedup, "FEW", few)
        plans.clear()
        found[few] = sorted(r[:] for r in near_dedup.near_duplicates(own).collect())
        assert any("_link" in p for p in plans)  # there are such members
        assert any("_link" in p and "BroadcastHashJoin" in p and "LeftSemi" in p for p in plans) == (few > 0)
    assert found[-1] == found[1 << 20]
