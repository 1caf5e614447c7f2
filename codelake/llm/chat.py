"""Chat formatting of reply trees.

Messages form trees by ``parent``. Self-joins that double the distance in each
round give every message its root, depth and branch score; the leaves of a tree
are ranked by score, and each chosen path from root to leaf is listed by further
doubling and formatted as one conversation. Rounds grow with the logarithm of
the depth, and messages stay rows until a path is written out.

Control strings inside texts and roles are escaped by one backslash more after
their first character than there was, which is undone by taking one away. The
loss mask is the list of places (code points) of assistant texts.

Null roles and texts count as empty. Rows with the same conversation and turn
follow one another in the order of role and text; a null turn comes first, a
null conversation is one of its own. Messages whose parent is missing are
roots. Messages on a cycle have no root and are left out, as in any forest.
Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.storage import Stored
from codelake.llm.spread import plain

# Marks of this and of other templates that a text must not forge.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


@dataclass(frozen=True)
class Template:
    """A turn is ``open`` role ``between`` text ``close``."""

    open: str = "<|turn|>"
    between: str = "<|says|>"
    close: str = "<|done|>"
    control: list[str] = field(default_factory=lambda: list(CONTROL))

    def pattern(self) -> str:
        """A control string, split after its first character, with any backslashes there."""
        marks = sorted({self.open, self.between, self.close, *self.control}, key=lambda m: (-len(m), m))
        # A backslash before a letter or digit would be a class or a reference.
        quote = "".join(c if c.isalnum() else f"\\{c}" for c in sorted({m[0] for m in marks}))
        rests = "|".join(r"\Q" + m[1:] + r"\E" for m in marks)
        return f"([{quote}])(\\\\*)(?=(?:{rests}))"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern().replace(r"(\\*)", r"\\(\\*)"), "$1$2")

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.open), self.escape(role), F.lit(self.between), self.escape(text), F.lit(self.close))


def chains(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before it."""
    rows = plain(rows, conversation, turn, "role", "text").select(
        F.col(conversation).alias("tree"), F.col(turn).alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("message", F.row_number().over(order).cast("long")).select(
        "tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The messages of the chosen paths: ``tree``, ``leaf``, ``branch`` (rank), ``place`` (from the root), role and text.

    ``branches`` paths of the highest score are chosen per tree and root; None
    chooses all. Ties go to the least leaf.
    """
    store = Stored(messages.sparkSession)
    messages = store.table(messages, "messages")
    known = messages.select("tree", "message").withColumnRenamed("message", "parent").withColumn("there", F.lit(True))
    same = ["tree", "parent"]
    null_safe = (F.col("m.tree").eqNullSafe(F.col("k.tree"))) & (F.col("m.parent") == F.col("k.parent"))
    jump = messages.alias("m").join(known.alias("k"), null_safe, "left").select(
        F.col("m.tree").alias("tree"), F.col("m.message").alias("message"),
        F.when(F.col("k.there"), F.col("m.parent")).alias("above"),
        F.when(F.col("k.there"), F.col("m.parent")).otherwise(F.col("m.message")).alias("top"), F.coalesce("m.score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("steps"),
    )
    steps: list[DataFrame] = []  # jumps over 1, 2, 4, ... messages
    jump = store.table(jump, "jumps")
    limit = messages.count()
    while True:
        steps.append(jump)
        if jump.where("above is not null").isEmpty() or (1 << len(steps)) > 2 * limit:
            break
        up = jump.select(F.col("tree"), F.col("message").alias("above"), F.col("above").alias("higher"), F.col("top").alias("topmost"), F.col("total").alias("more"), F.col("steps").alias("further"))
        pair = (F.col("j.tree").eqNullSafe(F.col("u.tree"))) & (F.col("j.above") == F.col("u.above"))
        jump = store.table(
            jump.alias("j").join(up.alias("u"), pair, "left").select(
                F.col("j.tree").alias("tree"), F.col("j.message").alias("message"), F.col("u.higher").alias("above"), F.coalesce("u.topmost", "j.top").alias("top"),
                (F.col("j.total") + F.coalesce("u.more", F.lit(0.0))).alias("total"), (F.col("j.steps") + F.coalesce("u.further", F.lit(0))).alias("steps"),
            ),
            "jumps",
        )
    rooted = steps[-1].where("above is null").select("tree", "message", "top", "total", "steps")
    replied = messages.where("parent is not null").select("tree", F.col("parent").alias("message")).distinct()
    apart = (F.col("r.tree").eqNullSafe(F.col("p.tree"))) & (F.col("r.message") == F.col("p.message"))
    leaves = rooted.alias("r").join(replied.alias("p"), apart, "left_anti")
    rank = Window.partitionBy("tree", "top").orderBy(F.desc("total"), "message")
    leaves = leaves.withColumn("branch", F.row_number().over(rank))
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    listed = leaves.select("tree", F.col("message").alias("leaf"), "branch", "steps", "message", F.lit(0).cast("long").alias("back"))
    for k, step in enumerate(steps[:-1]):
        up = step.where("above is not null").select("tree", "message", "above")
        pair = (F.col("l.tree").eqNullSafe(F.col("u.tree"))) & (F.col("l.message") == F.col("u.message"))
        further = listed.alias("l").join(up.alias("u"), pair).select(
            F.col("l.tree").alias("tree"), "leaf", "branch", "steps", F.col("u.above").alias("message"), (F.col("back") + (1 << k)).alias("back")
        )
        listed = store.table(listed.unionByName(further), "listed")
    body = messages.select("tree", "message", "role", "text")
    pair = (F.col("l.tree").eqNullSafe(F.col("b.tree"))) & (F.col("l.message") == F.col("b.message"))
    return listed.alias("l").join(body.alias("b"), pair).select(
        F.col("l.tree").alias("tree"), "leaf", "branch", (F.col("steps") - F.col("back")).alias("place"),
        F.coalesce("b.role", F.lit("")).alias("role"), F.coalesce("b.text", F.lit("")).alias("text"),
    )


def conversations(listed: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per path: ``tree``, ``branch``, ``formatted`` and ``loss``, places of assistant texts."""
    template = template or Template()
    turn = F.struct(
        "place",
        template.turn(F.col("role"), F.col("text")).alias("written"),
        (F.col("role") == "assistant").alias("learned"),
        F.length(F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.between))).alias("before"),
        F.length(template.escape(F.col("text"))).alias("size"),
        F.lit(len(template.close)).alias("after"),
    )
    rows = listed.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + t["before"] + t["size"] + t["after"]).alias("at"),
            F.when(t["learned"], F.concat(s["loss"], F.array(F.struct((s["at"] + t["before"]).alias("start"), t["size"].alias("size")))))
            .otherwise(s["loss"]).alias("loss"),
        ),
    )
    return rows.select("tree", "branch", F.array_join(F.col("turns.written"), "").alias("formatted"), walk["loss"].alias("loss"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``roles`` and ``texts`` of each conversation, read from ``formatted``, and ``learned``, the text under the mask."""
    template = template or Template()
    o, b, c = (rf"\Q{m}\E" for m in (template.open, template.between, template.close))
    shape = f"(?s){o}(.*?){b}(.*?){c}"
    plain_text = lambda x: template.unescape(x)
    return formatted.withColumn("roles", F.transform(F.regexp_extract_all("formatted", F.lit(shape), F.lit(1)), plain_text)).withColumn(
        "texts", F.transform(F.regexp_extract_all("formatted", F.lit(shape), F.lit(2)), plain_text)
    ).withColumn(
        "learned",
        F.array_join(F.transform("loss", lambda s: template.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"]))), ""),
    )


def digest(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Formats linear conversations and reports what can be read back from them."""
    back = read_back(conversations(paths(chains(rows)), template), template)
    turns = F.array_join(F.transform(F.arrays_zip(F.col("roles").alias("r"), F.col("texts").alias("t")), lambda x: F.concat(x["r"], F.lit("\n"), x["t"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").cast("long").alias("conv_id"),
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
