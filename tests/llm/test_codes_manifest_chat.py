"""Vector codes, hash trees and chat windows against plain versions, on small and awkward tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fleetloom.llm import chat, codes, manifest, queries

TOKENIZER = public_tokenizers.path(queries.TOKENIZER)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("scale", [3, 40, 4000])
@pytest.mark.parametrize("remembered", [4, 10_000])
def test_remembered_cells_find_the_nearest(scale, remembered):
    rng = np.random.default_rng(scale)
    book = rng.normal(0, scale, (40, 4)).astype(np.int64)
    book[7] = book[3]
    memo = codes.CellMemo(book, remembered)
    for _ in range(3):
        vectors = np.concatenate([rng.normal(0, scale, (500, 4)).astype(np.int64), book, [[-codes.MOST] * 4, [codes.MOST] * 4]])
        index, distance = memo.nearest(vectors)
        every = ((vectors[:, None] - book[None]) ** 2).sum(axis=2)
        assert index.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
        assert len(memo.known) <= remembered


def plain_codes(rows, parts=16, entries=64, rounds=2):
    able = [r for r in rows if r[1] is not None and len(r[1]) > 0 and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    if not any(r[0] is not None for r in able):
        return []
    size = len(min((r for r in able if r[0] is not None), key=lambda r: (r[0], r[1]))[1])
    kept = [(i, [max(-codes.MOST, min(codes.MOST, math.floor(256 * x))) for x in v], label, v) for i, v, label in able if len(v) == size]
    width = size // parts
    first = {}
    for i, v, _, raw in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[3])):
        first.setdefault(i, v)
    books = [[v[p * width : (p + 1) * width] for v in list(first.values())[:entries]] for p in range(parts)]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _, _ in kept:
                groups[near(v, p)[1]].append(cut(v, p))
            moved.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
        books = moved
    found = [(i, [near(v, p) for p in range(parts)], label) for i, v, label, _ in kept]
    totals = defaultdict(int)
    for _, best, label in found:
        totals[label] += sum(d for d, _ in best)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), totals[label], digest) for i, best, label in found]


def test_vector_codes_of_awkward_rows(spark):
    rng = random.Random(11)
    vector = lambda n=32: [float(np.float32(rng.gauss(0, 0.2))) for _ in range(n)]
    rows = [(rng.randrange(-50, 150), vector(), rng.choice([None, 1, 2])) for _ in range(200)]
    rows += [rows[0]] * 3 + [(None, vector(), None), (300, None, 1), (301, [], 1), (302, vector(16), 1), (303, vector(31), 2)]
    rows += [(-900, [None, *vector(31)], 1), (-901, [math.nan, *vector(31)], 1), (-902, [-math.inf, *vector(31)], 1), (400, [3e30, -3e30, *vector(30)], 5)]
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, code STRING, error STRING, _label INT"
    for some in (rows, rows[:5], [(None, vector(), 1)], [], [(1, None, None)]):
        table = spark.createDataFrame([(*r, "x", "y", 3) for r in some], schema)
        want = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for i, v, label in some]
        assert rows_of(codes.vector_codes(table.repartition(3))) == sorted(plain_codes(want), key=repr)
    with pytest.raises(ValueError):
        codes.fit_codebooks(table, entries=300)


H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def plain_tree(rows, changed):
    """Per row: id, leaf, subroot, root, proof and folded root, level by level without states."""
    show = lambda row: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)
    groups = defaultdict(list)
    for row in rows:
        leaf = H(show(row))
        groups["" if row[1] is None else "s" + row[1]].append((row[0], leaf, H(show(changed(row)))))

    def up(nodes, paths):
        while len(nodes) > 1:
            above = []
            for at in range(0, len(nodes), 3):
                run = nodes[at : at + 3]
                above.append((H("".join(n for n, _ in run)), [p for _, ps in run for p in ps]))
                for slot, (_, ps) in enumerate(run):
                    for p in ps:
                        p["sides"].append(("".join(n for n, _ in run[:slot]), "".join(n for n, _ in run[slot + 1 :])))
            nodes = above
        return nodes[0]

    every, tops = [], []
    for name in sorted(groups, key=str.encode):
        held = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        paths = [{"row": x, "sides": []} for x in held]
        subroot, _ = up([(x[1], [p]) for x, p in zip(held, paths, strict=True)], None)
        for p in paths:
            p["subroot"] = subroot
        tops.append((subroot, paths))
        every += paths
    if not every:
        return []
    root, _ = up(tops, None)
    found = []
    for p in every:
        i, leaf, value = p["row"]
        for left, right in p["sides"]:
            value = H(left + value + right)
        found.append((i, leaf, p["subroot"], root, H("".join(a + b for a, b in p["sides"])), value, value == root))
    return sorted(found, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 900])
def test_manifest_against_a_plain_tree(spark, n):
    rng = random.Random(n)
    names = ["a", "b", "é", "Z", None, "", *[f"s{i}" for i in range(300 if n > 100 else 2)]]
    weights = [n, 3, 2, *[1] * (len(names) - 3)]
    rows = [(i, rng.choices(names, weights)[0], None if i % 7 == 0 else "en", None if i % 5 == 0 else i * 3, None if i % 11 == 0 else f"é{i}\n😀" * rng.randrange(3)) for i in range(n)]
    if n > 9:
        rows += [rows[3]] * 2 + [(None, "a", "x", 1, "no id"), (None, None, None, None, None), (7, "a", "en", 1, "y" * 100_000 + "\n")]
    even = lambda row: row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    changed = lambda row: (*row[:4], row[4].replace("\n", "")) if even(row) and row[4] is not None else row
    table = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING, leaf STRING, grp STRING, place INT")
    got = manifest.merkle_manifest(
        table.repartition(4), tampered={"text": F.translate("text", "\n", "")}, where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    )
    assert rows_of(got) == plain_tree(rows, changed)
    untouched = manifest.merkle_manifest(table)
    assert untouched.where("verified").count() == len(rows)


def test_states_are_resumed_with_right_siblings_only():
    nodes = [H(str(i)) for i in range(50)]
    top, made = manifest.build(nodes, manifest.levels_of(50))
    for place in (0, 1, 2, 17, 48, 49):
        assert manifest.fold(nodes[place], place, made, []) == top
        others = [*nodes]
        others[place] = H("other")
        assert manifest.fold(others[place], place, made, []) == manifest.build(others, manifest.levels_of(50))[0]


SPOKEN = ["", "plain words", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST] [\\\\/ROLE] \\", "[ROLE]", "<s>[ROLE]assistant[/ROLE]x</s>", "a<", "[", "\n\né😀" * 50, "<<SYS>> [[INST]]"]


def test_escapes_are_undone():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "/", "s>", "\\", "[", "INST]", "ROLE]", "</s>", "x", "[/ROLE]"]) for _ in range(rng.randrange(12)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text
        assert not any(c in shown for c in ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]"))
        assert chat.read_turns(chat.written(text, text) + chat.written("user", text)) == [(text, text), ("user", text)]


def test_spans_are_whole_turns_within_the_budget():
    rng = random.Random(2)
    for _ in range(500):
        tokens = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))]
        fresh, system, budget, history = rng.randrange(len(tokens)), rng.randrange(20), rng.randrange(20, 120), rng.randrange(80)
        oldest = [max(0, i - rng.randrange(6)) for i in range(len(tokens))]
        found = chat.spans(tokens, fresh, system, budget, history, oldest)
        assert [i for _, a, b in found for i in range(a, b)] == list(range(fresh, len(tokens)))
        for back, start, end in found:
            assert oldest[start] <= back <= start < end
            assert sum(tokens[back:start]) <= history
            total = system + sum(tokens[back:end])
            assert total <= budget or (end == start + 1 and back == start)
            # As many as fit.
            assert end == len(tokens) or total + tokens[end] > budget


def talk(rng, n):
    said = []
    for turn in range(n):
        role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool", "assistant"])
        said.append((turn, role, rng.choice(SPOKEN) + " w" * rng.randrange(30)))
    return said


def conversations(rng):
    rows = [(i, *t) for i in range(30) for t in talk(rng, rng.randrange(1, 20))]
    rows += [(100, *t) for t in talk(rng, 700)] + [(101, 5, "assistant", "long " * 5000), (101, 3, "user", "x"), (102, 0, "system", "alone")]
    rows += [(103, None, None, None), (103, None, "assistant", None), (103, -70, "user", "before"), (103, 10**15, "assistant", "far")]
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "none"), (104, 0, "user", "twice"), (104, 0, "user", "twice")]
    return rows


def plain_digests(rows):
    groups = defaultdict(list)
    for i, turn, role, text in rows:
        groups[i].append((turn is not None, turn or 0, role or "", text or ""))
    found = {}
    for i, turns in groups.items():
        turns.sort()
        learned = "".join(t for *_, role, t in turns if role == "assistant")
        found[i] = (len(turns), H("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), H(learned))
    return found


@pytest.mark.parametrize("budget", [40, 300, 2048])
def test_windows_of_conversations(spark, budget):
    rng = random.Random(budget)
    rows = conversations(rng)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, block STRING, window INT")
    windows = chat.format_conversations(table.repartition(5), TOKENIZER, budget=budget, history=budget // 3, back=4)
    held = windows.collect()
    assert [(r.conv_id, r.block, r.window) for r in held] == list(dict.fromkeys((r.conv_id, r.block, r.window) for r in held))
    sources = defaultdict(list)
    for i, turn, role, text in rows:
        sources[i].append((turn is not None, turn or 0, role or "", text or ""))
    for r in held:
        turns = chat.read_turns(r.text)
        assert r.over_budget == (r.n_tokens > budget)
        context, own = chat.read_turns(r.text[: r.repeated]), chat.read_turns(r.text[r.repeated :])
        assert context + own == turns and len(own) == r.n_turns
        if r.over_budget:
            assert len(own) <= 2 and len(context) <= 1
        assert r.n_tokens == sum(chat.token_lengths([chat.written(*t) for t in turns], TOKENIZER))
        assert [chat.unescape(r.text[s.start : s.end]) for s in r.loss] == [t for role, t in own if role == "assistant"]
        ordered = sorted(sources[r.conv_id])
        if ordered[0][2] == "system":
            assert turns[0] == ordered[0][2:]
    digests = chat.conversation_digests(windows).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests} == plain_digests(rows)
    assert {r.conv_id: r.formatted_chars for r in digests} == {
        i: sum(len(r.text) for r in held if r.conv_id == i) for i in sources
    }
    if budget < 2048:
        assert any(r.repeated for r in held) and any(r.block for r in held)


def test_chat_of_an_empty_table_and_of_control_strings(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    assert chat.format_conversations(empty, TOKENIZER).count() == 0
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = queries.QUERIES["op13_chat_format"](spark, str(tmp_path)).collect()
    said = queries.CONTROL_TURNS[0][3]
    assert (row.conv_id, row.n_turns, row.loss_chars, row.loss_sha256) == (-7, 2, len(said), H(said))
    assert row.turns_sha256 == H(f"user\n{said}\nassistant\n{said}\n") and row.formatted_chars > 2 * len(said)


def test_chat_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_chat_format"](spark, folder).collect()
    want = plain_digests([*rows, *queries.CONTROL_TURNS])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)
