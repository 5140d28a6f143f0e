"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` signs that lead it (each after up to three spaces); a
passage is a run of lines of one level.  A message's own text are its level-0 lines without the lines
that introduce a quotation ("On ... wrote:" before a quoted line).  Lines are normalised (lower case,
letters and digits only, single spaces) and hashed.  A quoted line's original is the earliest message
of the conversation whose own text has the line, if that is earlier than the quoting message.

As mail clients wrap quotations again, the paragraphs of a passage are also taken as wholes: their lines are joined,
normalised and cut into shingles of ``WORDS`` words (a shorter paragraph is one shingle), which meet the shingles
of earlier messages' own text, each at the earliest message that has it.  The latest of these is the paragraph's
original if its own text has the whole paragraph (checked on the texts), else a message that holds half of the
paragraph's shingles or more is the original of what these cover.  Lines, shingles and whole paragraphs count by their
characters.  A message replies to the original of most quoted characters at its lowest linked quote level (ties: the
latest).  Replies form trees: ``root`` is the first message of a message's tree, ``depth`` the number
of replies between them, ``position`` its place in the tree's reply order: depth first, the replies to one message
by turn, so that a branch ends before the next one begins.

``threads`` builds the conversations: a row for each tree with its messages in reply order, without quotations, and
their text with the roles marked.  A tree of more than ``PART_CHARS`` characters is cut into rows of about that size,
in reply order by (part, piece); nothing is left out.

Defined results: null and empty texts quote nothing and stay empty; lines without letters and digits
link nothing; quotations without an original are removed and link nothing; messages without links are
their own root at depth 0; null conv_ids are one conversation; messages without a turn are neither
linked nor quoted; rows that repeat a (conv_id, turn) share one reply (the one of most characters).  An
empty table gives an empty result.  Other columns pass through; the operator's columns replace any of
their names.

Scale: DataFrame functions only.  Lines are split row by row; only conversations with quotations are cut into
shingles; originals are pre-aggregated to one row for each conversation and line or shingle, so a line that thousands of messages hold joins as one row.  Trees are
followed by pointer doubling (log2 of the depth rounds), without gathering a conversation anywhere.  Reply order comes
from the tour around each tree, a list whose elements each know the next one: doubling adds up messages and characters
to its end in log2 rounds, so that neither a tree nor the replies to one message go through one task; siblings are
found by a global sort that splits them among tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

WORDS = 5
#: Characters of a thread's row, but for one longer message; a message counts its text and MESSAGE_CHARS.
PART_CHARS = 1 << 20
MESSAGE_CHARS = 32
#: Marks of ``threads`` around a message: start, role, line end, text, end.
START, END = "<|im_start|>", "<|im_end|>"
_NO_TURN = -2**63
_MARK = "^(?:[ \\\\t]{0,3}>)+"
_INTRO = "^\\\\s*(?:On|Am|Le|El)\\\\b.*(?:wrote|schrieb|écrit|escribió)[^:]{0,80}:\\\\s*$"


def parsed(messages: DataFrame) -> DataFrame:
    """Add ``own`` (text without quotes), ``passages`` (level, lines), ``quoted`` (level, line) and
    ``paragraphs`` (level, paragraph: joined lines) arrays."""
    out = messages.withColumn("_lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r?\n"))
    out = out.withColumn("_levels", F.expr(
        f"transform(_lines, l -> length(regexp_replace(regexp_extract(l, '{_MARK}', 0), '[^>]', '')))"))
    out = out.withColumn("_bodies", F.expr(
        f"transform(_lines, (l, i) -> IF(_levels[i] = 0, l, trim(regexp_replace(l, '{_MARK}', ''))))"))
    # An introduction counts if the next line that isn't blank is quoted; blank lines between are few.
    out = out.withColumn("_keep", F.expr(
        f"transform(_levels, (v, i) -> v = 0 AND NOT (_bodies[i] RLIKE '{_INTRO}' AND (coalesce(get(_levels, i + 1), 0) > 0 OR "
        "(trim(coalesce(get(_bodies, i + 1), '')) = '' AND coalesce(get(_levels, i + 2), 0) > 0))))"))
    starts = "filter(sequence(0, size(_levels) - 1), i -> i = 0 OR _levels[i] <> get(_levels, i - 1))"
    out = out.withColumn("_starts", F.expr(starts))
    out = out.withColumn("passages", F.expr(
        "transform(_starts, (s, k) -> struct(_levels[s] AS level, "
        "slice(_bodies, s + 1, coalesce(get(_starts, k + 1), size(_levels)) - s) AS lines))"))
    # A message that quotes nothing stays as it is.
    out = out.withColumn("own", F.expr(
        "CASE WHEN exists(_levels, v -> v > 0) THEN regexp_replace(regexp_replace(array_join(filter(_bodies, (b, i) -> _keep[i]), "
        "'\n'), '\n{3,}', '\n\n'), '^\\\\s+|\\\\s+$', '') ELSE coalesce(CAST(text AS STRING), '') END"))
    out = out.withColumn("quoted", F.expr(
        "flatten(transform(filter(passages, p -> p.level > 0), p -> transform(p.lines, l -> struct(p.level AS level, l AS line))))"))
    out = out.withColumn("paragraphs", F.expr(
        "flatten(transform(filter(passages, p -> p.level > 0), p -> transform(split(array_join(p.lines, '\n'), '\n\\\\s*\n'), "
        "l -> struct(p.level AS level, l AS paragraph))))"))
    return out.drop("_lines", "_levels", "_bodies", "_keep", "_starts")


def _conv(conv_id: str) -> list[Column]:
    """A null-safe key of a conversation: (no_conv, conv)."""
    return [F.col(conv_id).isNull().alias("no_conv"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")).alias("conv")]


def _normal(line):
    return F.trim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", " "))


def _paragraph_links(keyed: DataFrame) -> DataFrame:
    """(no_conv, conv, turn, level, original, chars) of quoted paragraphs, over joined lines."""
    paragraphs = (keyed.where("size(paragraphs) > 0").select("no_conv", "conv", "turn", F.inline("paragraphs"))
                  .withColumn("paragraph", _normal(F.col("paragraph"))).where("paragraph <> ''").distinct()
                  .withColumn("words", F.split("paragraph", " "))
                  .withColumn("width", F.least(F.lit(WORDS), F.size("words"))))
    windows = "transform(sequence(0, size(words) - width), i -> struct({} xxhash64(array_join(slice(words, i + 1, width), ' ')) AS h))"
    # A shingle has its first word's characters, the last one those of all its words.
    chars = ("length(IF(i = size(words) - width, array_join(slice(words, i + 1, width), ' '), "
             "concat(words[i], ' '))) AS chars,")
    asked = (paragraphs.withColumn("n", F.expr("size(words) - width + 1"))
             .select("no_conv", "conv", "turn", "level", "paragraph", "n", "width", F.expr(f"inline({windows.format(chars)})")))
    widths = paragraphs.select("no_conv", "conv", "width").distinct()
    own = keyed.select("no_conv", "conv", "turn", _normal(F.col("own")).alias("own")).where("own <> ''")
    written = (own.withColumn("words", F.split("own", " ")).join(widths, ["no_conv", "conv"]).where("size(words) >= width")
               .select("no_conv", "conv", "turn", "width", F.expr(f"inline({windows.format('')})"))
               .groupBy("no_conv", "conv", "width", "h").agg(F.min("turn").alias("original")))
    key = ["no_conv", "conv", "turn", "level", "paragraph"]
    held = (asked.join(written, ["no_conv", "conv", "width", "h"]).where("original < turn")
            .groupBy(*key, "n", "original").agg(F.sum("chars").alias("chars"), F.count("*").alias("met")))
    candidates = (held.groupBy(*key, "n").agg(F.sum("met").alias("met"), F.max("original").alias("original"))
                  .where("met = n").drop("met", "n"))
    texts = own.select("no_conv", "conv", F.col("turn").alias("original"), "own")
    whole = (candidates.join(texts, ["no_conv", "conv", "original"])
             .where(F.expr("contains(concat(' ', own, ' '), concat(' ', paragraph, ' '))"))
             .select(*key, "original", F.length("paragraph").cast("long").alias("chars")).distinct())
    parts = held.where("2 * met >= n").select(*key, "original", "chars").join(whole.select(*key), key, "left_anti")
    return whole.unionByName(parts).select("no_conv", "conv", "turn", "level", "original", "chars")


def links(messages: DataFrame) -> DataFrame:
    """(no_conv, conv: conv_id as text, turn, reply_to) of the messages that quote an earlier one."""
    # Null conversations are one: a null-safe key.
    raw = (messages.select(*_conv("conv_id"), F.col("turn").try_cast("long").alias("turn"), F.col("text").cast("string").alias("text"))
           .where(f"turn <> {_NO_TURN}"))
    # Only conversations with a quoted line are parsed and moved.
    convs = T.stored(raw.where(F.col("text").rlike("(?m)^[ \\t]{0,3}>")).select("no_conv", "conv").distinct(), "quoting")
    keyed = parsed(raw.join(convs, ["no_conv", "conv"], "left_semi")).drop("text", "passages")
    line = _normal(F.col("line"))
    asked = (keyed.where("size(quoted) > 0").select("no_conv", "conv", "turn", F.inline("quoted"))
             .withColumn("line", line).where("line <> ''")
             .groupBy("no_conv", "conv", "turn", "level", F.xxhash64("line").alias("h")).agg(F.max(F.length("line")).alias("chars")))
    written = (keyed.select("no_conv", "conv", "turn", F.explode(F.split("own", "\n")).alias("line"))
               .withColumn("line", line).where("line <> ''")
               .groupBy("no_conv", "conv", F.xxhash64("line").alias("h")).agg(F.min("turn").alias("original")))
    lines = asked.join(written, ["no_conv", "conv", "h"]).where("original < turn")
    found = (lines.select("no_conv", "conv", "turn", "level", "original", "chars").unionByName(_paragraph_links(keyed))
             .groupBy("no_conv", "conv", "turn", "level", "original").agg(F.sum("chars").alias("chars")))
    # The lowest level first, then most characters, then the latest message.
    best = found.groupBy("no_conv", "conv", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "chars", "original")).alias("b"))
    return best.select("no_conv", "conv", "turn", F.col("b.original").alias("reply_to"))


_NODE = ["no_conv", "conv", "t"]


def _roots(linked: DataFrame) -> DataFrame:
    """(no_conv, conv, t, reply_to, root, depth) of linked messages by pointer doubling."""
    state = T.stored(linked.select("no_conv", "conv", F.col("turn").alias("t"), "reply_to", F.col("reply_to").alias("root"),
                                   F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = state.select("no_conv", "conv", F.col("t").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        met = state.join(up, ["no_conv", "conv", "root"], "left")
        state = T.stored(met.select(*_NODE, "reply_to", F.coalesce("up", "root").alias("root"),
                                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                                    F.col("up").isNotNull().alias("moved")), "replies")
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``i``, consecutive numbers by ``order``: a global sort, and one count for each of its partitions."""
    placed = T.stored(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("p", F.shiftright("at", 33))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = (placed.groupBy("p").count()
              .select("p", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")))
    return (placed.join(before, "p").withColumn("i", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
            .drop("at", "p", "before"))


def _tour(trees: DataFrame, chars: DataFrame) -> DataFrame:
    """The elements of the tours around all trees: each message is entered (``k`` 0), then its replies are toured by
    turn, then it is left (``k`` 1).  (nt, nk) is the next element; entering counts one message and its characters."""
    placed = _numbered(trees.select(*_NODE, F.col("reply_to").alias("parent")), ["no_conv", "conv", "parent", "t"])
    key = ["no_conv", "conv", "parent", "i"]
    after = placed.select("no_conv", "conv", "parent", F.col("t").alias("sibling"), (F.col("i") - 1).alias("i"))
    replies = placed.join(after, key, "left").drop("i")
    tops = trees.select("no_conv", "conv", F.col("root").alias("t")).distinct().withColumns(
        {"parent": F.lit(None).cast("long"), "sibling": F.lit(None).cast("long")})
    first = trees.groupBy("no_conv", "conv", F.col("reply_to").alias("t")).agg(F.min("t").alias("child"))
    nodes = replies.unionByName(tops).join(first, _NODE, "left").join(chars, _NODE, "left")
    return nodes.select("no_conv", "conv", F.inline(F.expr(
        "array(struct(t, 0 AS k, coalesce(child, t) AS nt, IF(child IS NULL, 1, 0) AS nk, 1L AS messages, coalesce(chars, 0L) AS chars), "
        "struct(t, 1 AS k, coalesce(sibling, parent) AS nt, IF(sibling IS NULL, 1, 0) AS nk, 0L AS messages, 0L AS chars))")))


def _places(trees: DataFrame, chars: DataFrame) -> DataFrame:
    """(no_conv, conv, t, position, offset) of all messages of the trees: the messages and characters before each one
    in reply order.  ``chars`` has (no_conv, conv, t, chars)."""
    state = T.stored(_tour(trees, chars), "tour")
    while not state.where("nt IS NOT NULL").isEmpty():
        ahead = state.select("no_conv", "conv", F.col("t").alias("nt"), F.col("k").alias("nk"), F.col("nt").alias("nt2"),
                             F.col("nk").alias("nk2"), F.col("messages").alias("m2"), F.col("chars").alias("c2"))
        # Each element is the next one of one other at most; those that have met the end stay as they are.
        moved = (state.where("nt IS NOT NULL").join(ahead, ["no_conv", "conv", "nt", "nk"])
                 .select(*_NODE, "k", F.col("nt2").alias("nt"), F.col("nk2").alias("nk"),
                         (F.col("messages") + F.col("m2")).alias("messages"), (F.col("chars") + F.col("c2")).alias("chars")))
        state = T.stored(state.where("nt IS NULL").unionByName(moved), "tour")
    entered = state.where("k = 0").select(*_NODE, "messages", "chars")
    of = trees.select(*_NODE, "root").unionByName(
        trees.select("no_conv", "conv", F.col("root").alias("t"), "root").distinct())
    whole = entered.select("no_conv", "conv", F.col("t").alias("root"), F.col("messages").alias("all"), F.col("chars").alias("sum"))
    return (entered.join(of, _NODE).join(whole, ["no_conv", "conv", "root"])
            .select(*_NODE, (F.col("all") - F.col("messages")).alias("position"), (F.col("sum") - F.col("chars")).alias("offset")))


def _turn(column: str) -> Column:
    return F.coalesce(F.col(column).try_cast("long"), F.lit(_NO_TURN))


def _placed(rows: DataFrame, trees: DataFrame, places: DataFrame) -> DataFrame:
    """Add reply_to, root, depth, position and offset to rows of messages (no_conv, conv, t)."""
    zero = F.lit(0).cast("long")
    known = places.join(trees, _NODE, "left")  # a tree's first message has a place only
    return (rows.join(known, _NODE, "left").withColumns({
        "root": F.coalesce("root", F.nullif(F.col("t"), F.lit(_NO_TURN))),
        **{c: F.coalesce(c, zero) for c in ("depth", "position", "offset")}}))


def conversations(messages: DataFrame) -> DataFrame:
    """All messages with text (own text only), reply_to, root, depth, position and n_quoted (quoted lines)."""
    ours = ["text", "reply_to", "root", "depth", "position", "n_quoted"]
    given = F.struct(*[F.col(f"`{c}`") for c in messages.columns if c not in ours]).alias("given")
    trees = _roots(links(messages.select("conv_id", "turn", "text")))
    places = _places(trees, trees.select(*_NODE, F.lit(0).cast("long").alias("chars")))
    rows = (parsed(messages.select(given, "text"))
            .select("given", F.col("own").alias("text"), F.size("quoted").alias("n_quoted"),
                    *_conv("given.conv_id"), _turn("given.turn").alias("t")))
    return _placed(rows, trees, places).select("given.*", *ours)


def threads(messages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The trees in reply order: conv_id, root, part, piece, n_messages, messages (turn, reply_to, role, text) and chat.

    A tree of more than ``part_chars`` characters has several rows, in order by (part, piece); a turn whose
    different texts have more than that is spread over pieces by their hashes."""
    role = F.col("role").cast("string") if "role" in messages.columns else F.lit(None).cast("string")
    trees = _roots(links(messages.select("conv_id", "turn", "text")))
    own = T.stored(parsed(messages.select("conv_id", "turn", role.alias("role"), "text"))
                   .select("conv_id", *_conv("conv_id"), _turn("turn").alias("t"), "role", F.col("own").alias("text")).distinct(), "own")
    chars = own.groupBy(*_NODE).agg(F.sum(F.length("text") + MESSAGE_CHARS).cast("long").alias("chars"))
    places = _places(trees, chars)
    large = chars.where(F.col("chars") > part_chars).select(*_NODE, F.ceil(F.col("chars") / part_chars).alias("pieces"))
    hashed = F.xxhash64("role", "text")
    rows = (_placed(own, trees, places).join(large, _NODE, "left")
            .withColumns({"part": F.floor(F.col("offset") / part_chars),
                          "piece": F.coalesce(F.pmod(hashed, F.col("pieces")), F.lit(0).cast("long"))}))
    told = F.struct("position", hashed.alias("hash"), F.nullif(F.col("t"), F.lit(_NO_TURN)).alias("turn"), "reply_to", "role", "text")
    marked = f"m -> concat('{START}', coalesce(m.role, ''), '\n', m.text, '{END}')"
    return (rows.groupBy("conv_id", "root", "part", "piece").agg(F.sort_array(F.collect_list(told)).alias("m"))
            .select("conv_id", "root", "part", "piece", F.size("m").alias("n_messages"),
                    F.expr("transform(m, m -> struct(m.turn, m.reply_to, m.role, m.text))").alias("messages"),
                    F.expr(f"array_join(transform(m, {marked}), '\n')").alias("chat")))
