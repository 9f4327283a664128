"""Groups of spelling variants, by walking a trie with a frontier table.

The words of a vocabulary form a trie, kept as a table of edges: a node is the hash of
the letters that lead to it. All words walk this trie at once, level by level: a state
is (word, position in the word, node, edits), and a step joins the states of one
level with the edges of that level. Without an edit a state may follow its own letter,
follow another one (a replacement) or skip a letter of the word (a deletion); with one
edit it may only follow its own letters. An insertion is a deletion seen from the
other word. A state at a word's end with one edit, at a node that ends a word, is a
neighbour. A node with a single word below needs no further walk: that word is
compared at once, so the walk ends where no two words go on together. Every pair found
is compared letter by letter, so a collision of hashes adds none, and it takes none
away, as nodes that fell together have the edges of both.

Words of ``LEVELS`` letters or more are few and would need a level for each of their
letters: they meet, exactly as well, at the hashes of what is left without one letter.

A node of the first three levels may carry any share of all states, but these levels
have at most as many edges as the alphabet allows, and are broadcast; so is a level of
few edges. The other levels are joined by a shuffle in which each state carries a salt
and each edge comes once for every salt.

Null texts have no words. The empty vocabulary has no groups. Ties between forms go to
the smaller word in code-point order. Repeated rows of documents count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varimill.llm.frames import stored

# Fixed value: letters that make up a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
FIRST_LEVELS = 3  # at most 90 letters, so 90^3 edges
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5  # a form is so many times as frequent as its variant
LEVELS = 64
BROADCAST_EDGES = 300_000  # of a level that is sent to all tasks; beyond, a salted join
SALTS = 8
STEP = 2  # levels walked before the frontier is stored


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """``doc_id``, ``run``: every maximal run of at least ``least`` letters, A-Z in
    lower case."""
    found = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rows.withColumn("run", F.translate("run", upper, upper.lower()))


def with_slips(found: DataFrame, every: int, column: str = "run") -> DataFrame:
    """One letter deleted from those runs whose crc32 with the document's id is
    divisible by ``every``; a null id is written as nothing."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col(column))
    h = F.crc32(name.cast("binary"))
    run = F.col(column)
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    slipped = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return found.withColumn(column, F.when(h % every == 0, slipped).otherwise(run))


def vocabulary(
    found: DataFrame, column: str = "run", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT
) -> DataFrame:
    """``word``, ``n`` of the runs that are long and frequent enough."""
    rows = found.select(F.col(column).alias("word")).where(F.char_length("word") >= least)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _node(letters: Column) -> Column:
    return F.xxhash64(letters)


def edges(words: DataFrame) -> DataFrame:
    """``level``, ``parent``, ``letter``, ``child``, ``below`` (words that pass the
    child) and ``sole`` (the word, if it is the only one)."""
    steps = words.select(
        "word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("level")
    )
    upto = F.substring(F.col("word"), F.lit(1), F.col("level"))
    along = F.substring(F.col("word"), F.lit(1), F.col("level") + 1)
    letter = F.substring(F.col("word"), F.col("level") + 1, F.lit(1))
    placed = steps.select(
        "level", _node(upto).alias("parent"), letter.alias("letter"), _node(along).alias("child"), "word"
    )
    grouped = placed.groupBy("level", "parent", "letter", "child")
    made = grouped.agg(F.count("*").alias("below"), F.min("word").alias("first"))
    return made.withColumn("sole", F.when(F.col("below") == 1, F.col("first"))).drop("first")


def _joined(states: DataFrame, level: DataFrame, on: Column, small: bool, salts: int) -> DataFrame:
    if small:
        return states.join(F.broadcast(level), on)
    salt = F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("e_salt")
    dealt = level.select("*", copies)
    return states.select("*", salt).join(dealt, on & (F.col("salt") == F.col("e_salt"))).drop("salt", "e_salt")


def _walked(states: DataFrame, level: DataFrame, small: bool, salts: int) -> DataFrame:
    """States one level deeper, with ``below`` and ``sole`` of their nodes; those that
    skip the last letter of their word stay at the node, with no word below."""
    own = F.substring(F.col("word"), F.col("position") + 1, F.lit(1))
    # A letter skipped at the end of a run of equal ones gives what skipping any gives.
    follows = F.substring(F.col("word"), F.col("position") + 2, F.lit(1))
    states = states.where(F.col("position") < F.char_length("word"))
    skipped = states.where((F.col("edits") == 0) & (own != follows)).select(
        "word", (F.col("position") + 1).alias("position"), "node", F.lit(1).alias("edits")
    )
    at_end = F.col("position") == F.char_length("word")
    ended = skipped.where(at_end).select("*", F.lit(0).cast("long").alias("below"), F.lit(None).cast("string").alias("sole"))
    here = level.select("parent", "letter", "child", "below", "sole")
    met = F.col("node") == F.col("parent")
    same = F.col("own") == F.col("letter")
    once = states.where("edits = 1").unionByName(skipped.where(~at_end)).withColumn("own", own)
    straight = _joined(once, here, met & same, small, salts)
    # Without an edit every edge of the node may be taken.
    free = _joined(states.where("edits = 0").withColumn("own", own), here, met, small, salts)
    free = free.withColumn("edits", F.when(same, 0).otherwise(1))
    moved = straight.unionByName(free).select(
        "word", (F.col("position") + 1).alias("position"), F.col("child").alias("node"), "edits", "below", "sole"
    )
    return moved.unionByName(ended)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _by_trie(words: DataFrame, broadcast_edges: int, salts: int) -> DataFrame:
    """Candidate pairs ``a``, ``b`` among words of at most ``LEVELS`` letters: of each
    pair of neighbours one way round at least."""
    table = stored(edges(words), "edges")
    # As many rows as there are levels.
    sizes = {r["level"]: r["n"] for r in table.groupBy("level").agg(F.count("*").alias("n")).collect()}
    # The root by the rule of all nodes: a constant would turn the first join into one
    # without a key.
    root = _node(F.substring(F.col("word"), F.lit(1), F.lit(0)))
    states = words.select("word", F.lit(0).alias("position"), root.alias("node"), F.lit(0).alias("edits"))
    at_end = (F.col("edits") == 1) & (F.col("position") == F.char_length("word"))
    met, ended = [], []
    for start in range(0, len(sizes), STEP):
        numbers = range(start, min(start + STEP, len(sizes)))
        made = []
        for number in numbers:
            small = number < FIRST_LEVELS or sizes[number] <= broadcast_edges
            states = _walked(states, table.where(F.col("level") == number), small, salts)
            made.append(states.withColumn("level", F.lit(number)))
            # Where one word is below, the walk is over.
            states = states.where("below > 1").drop("below", "sole")
        # What is found on any level of the step, and from where to go on.
        go_on = (F.col("level") == numbers[-1]) & (F.col("below") > 1)
        found = (F.col("sole") != F.col("word")) | (at_end & F.col("sole").isNull())
        kept = stored(_union(made).where(go_on | found), "frontier")
        met.append(kept.where("sole <> word").select(F.col("word").alias("a"), F.col("sole").alias("b")))
        ended.append(kept.where(at_end & F.col("sole").isNull()).select("word", "node"))
        states = kept.where(go_on).select("word", "position", "node", "edits")
        if states.isEmpty():
            break
    nodes = words.select(_node(F.col("word")).alias("end"), F.col("word").alias("b"))
    last = _union(ended).join(nodes, F.col("node") == F.col("end")).select(F.col("word").alias("a"), "b")
    return _union([*met, last])


def _by_gaps(words: DataFrame) -> DataFrame:
    """All pairs of neighbours among long words, at the hashes of what is left without
    one letter: equal at the same place, or equal to the whole other word."""
    rest = F.transform(
        F.sequence(F.lit(0), F.char_length("word") - 1),
        lambda at: F.xxhash64(
            F.concat(
                F.substring(F.col("word"), F.lit(1), at),
                F.substring(F.col("word"), at + 2, F.char_length("word")),
            )
        ),
    )
    # A digest stands for the word, which may be long.
    named = words.select("word", F.md5("word").alias("name"))
    gaps = stored(named.select("name", F.posexplode(rest).alias("at", "gap")), "gaps")
    other = gaps.select(F.col("name").alias("o_name"), F.col("at").alias("o_at"), F.col("gap").alias("o_gap"))
    replaced = gaps.join(
        other,
        (F.col("gap") == F.col("o_gap")) & (F.col("at") == F.col("o_at")) & (F.col("name") < F.col("o_name")),
    )
    whole = named.select(F.col("name").alias("o_name"), F.xxhash64("word").alias("whole"))
    shorter = gaps.join(whole, F.col("gap") == F.col("whole"))
    pairs = replaced.select("name", "o_name").unionByName(shorter.select("name", "o_name")).distinct()
    firsts = named.select(F.col("name"), F.col("word").alias("a"))
    seconds = named.select(F.col("name").alias("o_name"), F.col("word").alias("b"))
    return pairs.join(firsts, "name").join(seconds, "o_name").select("a", "b")


def neighbours(
    words: DataFrame, levels: int = LEVELS, broadcast_edges: int = BROADCAST_EDGES, salts: int = SALTS
) -> DataFrame:
    """``word``, ``near``: all ordered pairs of different words of the column ``word``
    that one inserted, deleted or replaced code point turns into each other."""
    words = words.select("word").where("word <> ''").distinct()
    size = F.char_length("word")
    short, long = words.where(size <= levels), words.where(size >= levels)
    found = _by_gaps(long)
    if not short.isEmpty():
        found = found.unionByName(_by_trie(short, broadcast_edges, salts))
    # A word is its own neighbour by no edit; pairs come from either side.
    pairs = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = stored(pairs.where(F.levenshtein("a", "b", 1) == 1), "neighbours")
    return near.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for words that have a form, by doubling the pointers; a form
    is more frequent than its word, so there is no circle."""
    current = forms.select("word", F.col("form").alias("root"))
    while True:
        up = current.select(F.col("word").alias("u_word"), F.col("root").alias("u_root"))
        current = stored(
            current.join(up, F.col("root") == F.col("u_word"), "left").select(
                "word", F.coalesce("u_root", "root").alias("root"), F.col("u_root").isNotNull().alias("moved")
            ),
            "roots",
        )
        if current.where("moved").isEmpty():
            return current.select("word", "root")
        current = current.drop("moved")


def group_variants(words: DataFrame, times: int = TIMES, **options) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of
    ``words`` (``word``, ``n``).

    The form is the most frequent neighbour, if it is ``times`` as frequent as the word
    at least; the root is where following forms ends.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = neighbours(words, **options).join(counts, "near")
    # Most frequent first, of equals the smallest.
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    told = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(told, "word", "left")
    enough = -F.col("best.n") >= times * F.col("n")
    rows = stored(
        rows.select(
            "word",
            F.when(enough, F.col("best.w")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(rows.where("form is not null"))
    joined = rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return joined.select("word", "form", "root", "n", "n_near", "form_n")
