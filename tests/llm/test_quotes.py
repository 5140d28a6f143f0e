"""Quotation linking and reply order against a brute-force linker on generated conversations."""

import random
import re
import textwrap
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from supplyscope.llm import quotes

SCHEMA = "conv_id string, turn long, role string, text string"
MARK = re.compile(r"^(?:[ \t]{0,3}>)+")
INTRO = re.compile(r"^\s*(?:On|Am)\b.*(?:wrote|schrieb)[^:]{0,80}:\s*$")


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def parse(text):
    """Own text, quoted (level, line) pairs and quoted (level, paragraph) pairs."""
    lines = re.split("\r?\n", text or "")
    marks = [MARK.match(x) for x in lines]
    levels = [m.group().count(">") if m else 0 for m in marks]
    bodies = [x[m.end():].strip(" ") if m else x for x, m in zip(lines, marks)]
    if not any(levels):
        return text or "", [], []
    level = lambda i: levels[i] if i < len(levels) else 0
    own = [b for i, (b, v) in enumerate(zip(bodies, levels)) if v == 0 and not (INTRO.match(b) and (
        level(i + 1) or (i + 1 < len(bodies) and not bodies[i + 1].strip() and level(i + 2))))]
    passages = []
    for b, v in zip(bodies, levels):
        if passages and passages[-1][0] == v:
            passages[-1][1].append(b)
        else:
            passages.append((v, [b]))
    quoted = {(v, normal(b)) for v, bs in passages for b in bs if v and normal(b)}
    whole = {(v, normal(p)) for v, bs in passages if v for p in re.split(r"\n\s*\n", "\n".join(bs)) if normal(p)}
    return re.sub("\n{3,}", "\n\n", "\n".join(own)).strip(), quoted, whole


def shingle_list(words, width):
    return [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]


def reply_of(turn, quoted, whole, earlier):
    """The turn that a message replies to; ``earlier`` has (turn, own text) in order of turns."""
    found = Counter()
    for v, line in quoted:
        have = [t for t, own in earlier if line in {normal(x) for x in own.split("\n")}]
        if have:
            found[v, have[0]] += len(line)
    for v, paragraph in whole:
        words = paragraph.split(" ")
        width = min(quotes.WORDS, len(words))
        asked = shingle_list(words, width)
        chars, met = Counter(), Counter()
        for i, s in enumerate(asked):
            have = [t for t, own in earlier if s in shingle_list(normal(own).split(" "), width)]
            if have:
                met[have[0]] += 1
                chars[have[0]] += len(s) if i == len(asked) - 1 else len(words[i]) + 1
        latest = max(met, default=None)
        if sum(met.values()) == len(asked) and any(
                t == latest and f" {paragraph} " in f" {normal(own)} " for t, own in earlier):
            found[v, latest] += len(paragraph)
        else:
            for t in met:
                if 2 * met[t] >= len(asked):
                    found[v, t] += chars[t]
    return max(((-v, n, t) for (v, t), n in found.items()), default=(0, 0, None))[2]


def brute(rows):
    """{(conv, turn): (reply_to, root, depth, position)} of rows with turns, by walking each tree."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1], *parse(r[3])) for r in rows if r[0] == conv)
        reply = {}
        for t, _, quoted, whole in mine:
            reply[t] = reply_of(t, quoted, whole, [(u, own) for u, own, _, _ in mine if u < t])
        below = defaultdict(list)
        for t in sorted(reply):
            below[reply[t]].append(t)
        for root in below[None]:
            stack, position = [(root, 0)], 0
            while stack:
                t, depth = stack.pop()
                out[conv, t] = (reply[t], root, depth, position)
                position += 1
                stack += [(u, depth + 1) for u in reversed(below[t])]
    return out


def quote(text, rnd):
    """A message's text as a reply quotes it: whole or in part, as it is or wrapped again, one level deeper."""
    lines = text.split("\n")
    if rnd.random() < 0.4:
        lo = rnd.randrange(len(lines))
        lines = lines[lo:lo + rnd.randrange(1, 4)]
    if rnd.random() < 0.4 and not any(MARK.match(x) for x in lines):
        lines = textwrap.wrap(" ".join(lines), rnd.choice([12, 25, 40])) or [""]
    return "\n".join(">" + (x if x.startswith(">") else " " + x) for x in lines)


def generated(seed, convs=25):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for c in range(convs):
        said = []
        for t in range(rnd.randrange(1, 14)):
            own = "\n".join(" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 16))) for _ in range(rnd.randrange(1, 4)))
            if said and rnd.random() < 0.8:
                head = "On Monday, Ann wrote:\n" if rnd.random() < 0.5 else ""
                own = head + quote(rnd.choice(said), rnd) + "\n" + rnd.choice(["", "\n"]) + own
                if rnd.random() < 0.3:
                    own += "\n" + quote(rnd.choice(said), rnd)
            said.append(own)
            rows.append((f"c{c}" if c else None, t * 3, rnd.choice(["user", "assistant", None]), own))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_and_reply_order_equal_brute_force(spark, seed):
    rows = generated(seed)
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.conv_id, r.turn): (r.reply_to, r.root, r.depth, r.position) for r in quotes.conversations(df).collect()}
    assert got == want
    assert max(d for _, _, d, _ in want.values()) > 2 and sum(r is not None for r, _, _, _ in want.values()) > 50


@pytest.mark.parametrize("part_chars", [1 << 20, 150])
def test_threads_are_the_trees_in_reply_order(spark, part_chars):
    rows = generated(4)
    want = defaultdict(list)
    texts = {(c, t): (role, parse(x)[0]) for c, t, role, x in rows}
    for (c, t), (reply, root, _, position) in sorted(brute(rows).items(), key=lambda e: e[1][3]):
        want[c, root].append((t, reply, *texts[c, t]))
    got, chats = defaultdict(list), defaultdict(list)
    parts = quotes.threads(spark.createDataFrame(rows + rows[:9], SCHEMA).repartition(3), part_chars).collect()
    for r in sorted(parts, key=lambda r: (r.part, r.piece)):
        assert r.n_messages == len(r.messages)
        got[r.conv_id, r.root] += [tuple(m) for m in r.messages]
        chats[r.conv_id, r.root].append(r.chat)
    assert got == want
    assert (len(parts) > len(want)) == (part_chars == 150)
    for key, told in want.items():
        assert "\n".join(chats[key]) == "\n".join(f"<|im_start|>{role or ''}\n{own}<|im_end|>" for _, _, role, own in told)


def test_a_branch_ends_before_the_next_one_begins(spark):
    rows = [("a", 0, "u", "first question here"), ("a", 1, "u", "> first question here\nanswer one"),
            ("a", 2, "u", "> first question here\nanswer two"), ("a", 3, "u", "> answer one\nthanks to one")]
    got = quotes.threads(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [[m.turn for m in r.messages] for r in got] == [[0, 1, 3, 2]]
    assert got[0].chat.startswith("<|im_start|>u\nfirst question here<|im_end|>\n<|im_start|>u\nanswer one<|im_end|>\n")


def test_a_message_with_many_replies_and_a_long_chain(spark):
    star = [("star", i, "u", f"message {i}" if i == 0 else f"> message 0\nreply {i}") for i in range(300)]
    chain = [("chain", i, "u", f"> message number {i - 1} here\nmessage number {i} here") for i in range(100)]
    parts = quotes.threads(spark.createDataFrame(star + chain, SCHEMA), 1000).collect()
    told = defaultdict(list)
    for r in sorted(parts, key=lambda r: r.part):
        assert sum(len(m.text) + quotes.MESSAGE_CHARS for m in r.messages) <= 1000 + 60
        told[r.conv_id] += [m.turn for m in r.messages]
    assert told == {"star": list(range(300)), "chain": list(range(100))}


def test_threads_of_odd_tables(spark):
    rows = [(None, None, "u", "a"), (None, None, "u", "a"), (None, None, None, None), ("x", None, "u", "> a\nb"),
            ("x", 1, "u", "one"), ("x", 1, "u", "two"), ("x", 1, "u", "one"), ("x", 2, None, "> one\nyes"), ("y", 0, "u", ""),
            ("y", 1, "u", "long " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("own", F.lit("clash")).withColumn("part", F.lit("clash"))
    got = {(r.conv_id, r.root): [(m.turn, m.reply_to, m.text) for m in r.messages] for r in quotes.threads(df).collect()}
    assert sorted(got[None, None], key=lambda m: m[2]) == [(None, None, ""), (None, None, "a")]
    assert got["x", None] == [(None, None, "b")] and got["x", 1][2:] == [(2, 1, "yes")]
    assert sorted(got["x", 1][:2]) == [(1, None, "one"), (1, None, "two")]
    assert got["y", 0] == [(0, None, "")] and got["y", 1] == [(1, None, "long " * 300_000)] and len(got) == 5
    # One turn with more text than a row takes is spread over pieces, and nothing is lost.
    many = [("z", 5, "u", f"text {i} of this turn") for i in range(200)]
    parts = quotes.threads(spark.createDataFrame(many, SCHEMA), 500).collect()
    assert len(parts) > 5 and sorted(m.text for r in parts for m in r.messages) == sorted(r[3] for r in many)
    # Other columns pass through whatever their names, and the operator's own names are replaced.
    kept = quotes.conversations(df).where("conv_id = 'x' AND turn = 2").first()
    assert (kept.own, kept.part, kept.text, kept.reply_to, kept.position) == ("clash", "clash", "yes", 1, 1)
    assert quotes.threads(df.drop("role")).where("conv_id = 'y'").count() == 2
    assert quotes.threads(df.limit(0)).count() == 0
    numbers = quotes.conversations(df.limit(3).withColumn("conv_id", F.lit(1.5))).select("conv_id").distinct().collect()
    assert [r.conv_id for r in numbers] == [1.5]


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([("a", 0, "u", "x"), ("a", 1, "u", "> x\ny")], SCHEMA)
    for made in (quotes.threads(df), quotes.conversations(df)):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())
