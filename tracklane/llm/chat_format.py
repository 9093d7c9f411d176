"""Chat formatting: the hash of a record's nested field paths selects a declarative mapping to canonical turns.

Records are rows of JSON (turns_of_json), rows of one table whose layouts differ from row to row (turns_of_rows), or a table
of one layout (turns_of_table). A layout may rename roles; PLAIN are the same layouts without new names.

A template then marks turns and escapes control strings inside texts reversibly. DataFrame expressions only.

Defined cases: a null text is an empty text, a null role an empty role, rows of equal turn number are ordered by role and
text, repeated rows stay, unknown layouts give null turns (never an error), empty tables give empty results, and extra
fields take part in the path hash only through `paths`, the fields that a layout is known by. A message may lack one of its
two fields (empty then); a list with a message that has neither is an unknown layout.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: the nested field paths that identify a layout, and where its turns are.

    `single` lists (role, path) for flat records, null ones left out; `items` names an array of messages with its role and
    text fields. `roles` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    single: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


#: Role names of other layouts and their canonical names.
ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("prompt", ("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("completion", "prompt"), single=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_system", ("prompt", "response", "system"), single=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question", ("answer", "question"), single=(("user", "question"), ("assistant", "answer"))),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), items=("messages", "role", "content"), roles=ROLES),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles=ROLES),
    Layout("turns", ("turns", "turns[].role", "turns[].text"), items=("turns", "role", "text")),
)
PLAIN = tuple(replace(y, roles=()) for y in LAYOUTS)

TURN_END = "</turn>"
HEAD = "### "


def fields(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; `[]` stands for array items."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in [f"{at}.{f.name}".lstrip("."), *fields(f.dataType, f"{at}.{f.name}".lstrip("."))]]
    if isinstance(schema, T.ArrayType):
        return fields(schema.elementType, f"{at}[]")
    return []


def fingerprint(paths) -> Column:
    """Hash of the sorted field paths; `paths` is a list of names or an array column."""
    column = paths if isinstance(paths, Column) else F.array(*[F.lit(p) for p in paths]).cast("array<string>")
    return F.xxhash64(F.array_join(F.array_sort(column), "\n"))


def json_paths(variant: Column) -> Column:
    """Field paths of JSON records, row by row: object keys at two levels, those of all array items as `[]`."""
    record = F.try_variant_get(variant, "$", "map<string,variant>")
    keys = lambda x: F.coalesce(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast("array<string>"))
    items = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    inner = lambda k, v: F.transform(F.array_distinct(F.flatten(F.transform(items(v), keys))), lambda x: F.concat(k, F.lit("[]."), x))
    top = F.map_entries(record)
    return F.flatten(F.transform(top, lambda e: F.concat(F.array(e["key"]), inner(e["key"], e["value"]))))


def _role(c: Column, roles) -> Column:
    out = F.coalesce(c, F.lit(""))
    for other, own in roles:
        out = F.when(c == other, F.lit(own)).otherwise(out)
    return out


def turns_of_json(df: DataFrame, record: str, layouts=LAYOUTS) -> DataFrame:
    """Appends `layout` and `turns` to rows with one JSON record each. Broken JSON and unknown layouts: null in both."""
    names = df.columns
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.try_parse_json(F.col(record)).alias("_v"))
    df = df.withColumn("_paths", json_paths(F.col("_v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    get = lambda x, path: F.try_variant_get(x, f"$.{path}", "string")
    message = lambda y: lambda x: F.struct(_role(get(x, y.items[1]), y.roles).alias("role"), F.coalesce(get(x, y.items[2]), F.lit("")).alias("text"))
    # of several layouts the one with most fields, as it comes last; of equals the first
    for y in sorted(reversed(layouts), key=lambda y: len(y.paths)):
        hit = fingerprint(F.array_intersect("_paths", F.array(*[F.lit(p) for p in y.paths]))) == fingerprint(y.paths)
        if y.items:
            listed = F.try_variant_get(F.col("_v"), f"$.{y.items[0]}", "array<variant>")
            own = F.transform(listed, message(y))
            has = lambda x, y=y: F.arrays_overlap(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), F.array(*[F.lit(p) for p in y.items[1:]]))
            hit = hit & F.forall(listed, lambda x: F.coalesce(has(x), F.lit(False)))
        else:
            own = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), get(F.col("_v"), p).alias("text")) for r, p in y.single]), lambda x: x["text"].isNotNull())
        name, turns = F.when(hit, F.lit(y.name)).otherwise(name), F.when(hit, own).otherwise(turns)
    own = [F.col("r")[c].alias(c) for c in names if c not in ("layout", "turns")]
    return df.select(*own, name.alias("layout"), turns.alias("turns"))


def turns_of_table(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Appends `turns` to a table whose columns follow one of the layouts, chosen by the hash of its nested field paths.

    Of the fields those of each layout are hashed; a hash that is a layout's own selects it, and of several the layout with
    most fields. So columns outside every layout are ignored. ValueError if there is none.
    """
    have = fields(df.schema)
    one = df.sparkSession.sql("select 1")  # a row without a job
    known = one.select(*[fingerprint(y.paths).alias(y.name) for y in layouts]).first().asDict()
    mine = one.select(*[fingerprint([p for p in have if p in y.paths]).alias(y.name) for y in layouts]).first()
    named = {known[y.name]: y for y in layouts}
    fits = [named[h] for h in mine if h in named]
    if not fits:
        raise ValueError(f"no layout for the fields {sorted(have)}")
    return df.withColumn("turns", _mapped(max(fits, key=lambda y: len(y.paths))))


def _mapped(y: Layout) -> Column:
    """Turns of a row whose columns have the layout."""
    if y.items:
        a, r, t = y.items
        return F.transform(F.col(a), lambda x: F.struct(_role(x[r], y.roles).alias("role"), F.coalesce(x[t], F.lit("")).alias("text")))
    own = F.array(*[F.struct(F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for r, p in y.single])
    return F.filter(own, lambda x: x["text"].isNotNull())


def turns_of_rows(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Appends `layout` and `turns` to a table whose rows have different layouts: of a row those columns count that aren't null.

    The paths of these columns, as far as a layout knows them, are hashed row by row; the hash that is a layout's own selects
    its mapping, of several that with most fields. Rows of no layout have null in both.
    """
    names = [c for c in df.columns if c not in ("layout", "turns")]
    have = fields(df.schema)
    of = lambda c: [p for p in have if p == c or p.startswith((f"{c}[]", f"{c}."))]
    none = F.array().cast("array<string>")
    present = F.flatten(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.array(*[F.lit(p) for p in of(c)])).otherwise(none) for c in df.columns]))
    df = df.withColumn("_paths", present)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for y in sorted(reversed([y for y in layouts if set(y.paths) <= set(have)]), key=lambda y: len(y.paths)):
        hit = fingerprint(F.array_intersect("_paths", F.array(*[F.lit(p) for p in y.paths]))) == fingerprint(y.paths)
        name, turns = F.when(hit, F.lit(y.name)).otherwise(name), F.when(hit, _mapped(y)).otherwise(turns)
    return df.select(*[F.col(f"`{c}`") for c in names], name.alias("layout"), turns.alias("turns"))


def in_layouts(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turns, messages, conversations): gather()ed conversations, each in one of three layouts by its key, the other columns null."""
    kind = F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(3))
    as_ = lambda r, t: F.transform("turns", lambda x: F.struct(x["role"].alias(r), x["text"].alias(t)))
    return gather(df, key, turn, role, text).select(key, F.when(kind == 0, F.col("turns")).alias("turns"), F.when(kind == 1, as_("role", "content")).alias("messages"), F.when(kind == 2, as_("from", "value")).alias("conversations"))


def gather(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turns): one row per conversation from rows by turn."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_rows")).select(
        key, F.transform("_rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    )


def escape(c: Column) -> Column:
    """After this a text holds neither TURN_END nor HEAD, and every backslash starts a pair."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit(TURN_END), F.lit("<\\/turn>")), F.lit("##"), F.lit("#\\#"))


def unescape(c: Column) -> Column:
    """The inverse of escape: drop the first backslash of each pair."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """`### Role: text</turn>` and a new line for each turn, texts and roles escaped."""
    one = lambda x: F.concat(F.lit(HEAD), F.replace(escape(x["role"]), F.lit(":"), F.lit("\\:")), F.lit(": "), escape(x["text"]), F.lit(TURN_END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, end) code point offsets, from 0, of the escaped texts under the loss mask in the formatted string."""
    piece = lambda x: F.struct(
        (F.length(F.replace(escape(x["role"]), F.lit(":"), F.lit("\\:"))) + len(HEAD) + 2).alias("head"),
        F.length(escape(x["text"])).alias("body"),
        (x["role"] == role).alias("loss"),
    )
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + x["head"] + x["body"] + len(TURN_END) + 1).cast("int").alias("at"),
        F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["head"]).cast("int").alias("start"), (a["at"] + x["head"] + x["body"]).cast("int").alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(F.transform(turns, piece), zero, step, lambda a: a["spans"])


def parsed(output: Column) -> Column:
    """Turns read back from a formatted string."""
    pieces = F.slice(F.split(output, TURN_END + "\n", -1), 1, F.greatest(F.size(F.split(output, TURN_END + "\n", -1)) - 1, F.lit(0)))
    role = lambda p: F.regexp_extract(p, r"(?s)^### ((?:\\.|[^:\\])*): ", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + len(HEAD) + 3)).alias("text")))


def chat_format(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """Appends `formatted` and `loss_spans` to rows of canonical turns."""
    return conversations.withColumns({"formatted": formatted(F.col(turns)), "loss_spans": loss_spans(F.col(turns))})
