r"""Chat formatting (operator 6), DataFrame functions only.

Records come in many layouts. The layout of a record is its set of nested field paths, such as `messages[].role`; the hash of that set is its fingerprint, and a fingerprint selects
a declarative mapping that gives the record's turns as an array of (turn, role, text). `to_turns` takes records as structs or as JSON text: the paths of a struct are those of its type,
those of a JSON record are read from it, so records of mixed layouts can share a column. Only fields that a mapping knows are hashed, in sorted order, so more fields and another order of
fields change nothing. `from_table` makes a record of each row of a table, and `from_json` reads a column of JSON.

Template: each turn is `<s>[INST]role[/INST]text</s>`. Inside roles and texts a backslash is doubled and a control string gets one backslash after its first character,
so a control string in the output is always the template's own, and undoing both restores the text. A formatted conversation is an array of segments, each with a flag
that tells whether it counts for the loss (the texts of assistant turns); the formatted string is the segments in a row.

Defined cases: a null text or role is empty; turns order by turn (nulls first), then role and text, so ties have one order; repeated rows are separate turns; rows whose
conversation id is null are one conversation; a record that is no JSON or whose layout has no mapping has no turns and keeps its fingerprint (nothing is dropped, but a table whose
rows have no mapping is refused); long texts are formatted whole; an empty table gives an empty result, other columns are ignored. A conversation is one output value, so it must fit in one row; the order of its turns is made by sorting
that one array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import table

OPEN, NAMED, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(f"{word[0]}\\{word[1:]}"))
    return out


def unescape(text: Column) -> Column:
    for word in CONTROL:
        text = F.replace(text, F.lit(f"{word[0]}\\{word[1:]}"), F.lit(word))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def fingerprint(paths: Column) -> Column:
    """Hash of a layout: the sorted field paths of a record."""
    return F.sha2(F.array_join(F.array_sort(paths), ","), 256)


TURNS = "array<struct<turn:bigint,role:string,text:string>>"


class Record:
    """A record whose fields can be read by path, whether it is a struct or a variant."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind

    def paths(self) -> Column:
        """The known paths of this record."""
        if isinstance(self.kind, T.StructType):
            found = [f for f in self.kind.fieldNames() if f in KNOWN]
            for name in found[:]:
                inner = self.kind[name].dataType
                if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType):
                    found += [f"{name}[].{f}" for f in inner.elementType.fieldNames() if f"{name}[].{f}" in KNOWN]
            return F.array(*[F.lit(f) for f in found]).cast("array<string>")
        known = F.array(*[F.lit(p) for p in sorted(KNOWN)])
        keys = [F.map_keys(F.try_variant_get(self.column, "$", "map<string,variant>"))]
        for name in LISTS:
            inside = F.map_keys(F.try_variant_get(self.column, f"$.{name}[0]", "map<string,variant>"))
            before = F.lit(f"{name}[].")
            keys.append(F.transform(inside, lambda k: F.concat(before, k)))  # noqa: B023  the function is called at once
        return F.array_intersect(F.flatten(F.array(*[F.coalesce(k, F.array().cast("array<string>")) for k in keys])), known)

    def get(self, path: str, kind: str) -> Column:
        if isinstance(self.kind, T.StructType):
            return self.column[path].cast(kind) if path in self.kind.fieldNames() else F.lit(None).cast(kind)
        return F.try_variant_get(self.column, f"$.{path}", kind)


    def list(self, path: str, *names: str) -> Column:
        """A list of records with text fields; a field that they lack is null."""
        if isinstance(self.kind, T.StructType):
            inner = self.kind[path].dataType.elementType
            have = inner.fieldNames() if isinstance(inner, T.StructType) else []
            return F.transform(self.column[path], lambda t: F.struct(*[(t[f] if f in have else F.lit(None)).cast("string").alias(f) for f in names]))
        return F.try_variant_get(self.column, f"$.{path}", f"array<struct<{', '.join(f'{f}: string' for f in names)}>>")


def _turn(role: Column, text: Column, turn: Column | None = None) -> Column:
    return F.struct((F.lit(None) if turn is None else turn).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))


def fields(*path_and_role: tuple[str, str], second_paragraph: str | None = None) -> Callable[[Record], Column]:
    """Mapping of a record with a field for each turn. An empty system text is no turn; second_paragraph names a field that joins the first turn."""

    def turns(r: Record) -> Column:
        found = []
        for k, (path, role) in enumerate(path_and_role):
            text = r.get(path, "string")
            if k == 0 and second_paragraph:
                text = F.concat_ws("\n\n", text, F.nullif(r.get(second_paragraph, "string"), F.lit("")))
            found.append(_turn(F.lit(role), text))
        return F.filter(F.array(*found), lambda t: (t["role"] != "system") | (F.coalesce(t["text"], F.lit("")) != ""))

    return turns


def items(path: str, role: str, text: str, **renamed: str) -> Callable[[Record], Column]:
    """Mapping of a record with a list of turns; renamed: roles under another name."""

    def turns(r: Record) -> Column:
        def one(t: Column) -> Column:
            name = F.lower(t[role])
            for old, new in renamed.items():
                name = F.when(name == old, new).otherwise(name)
            return _turn(name, t[text])

        return F.transform(r.list(path, role, text), one)

    return turns


def pairs(path: str, last: Callable[[Record], Column]) -> Callable[[Record], Column]:
    """Mapping of a record with a list of (user, assistant) pairs, and the last turns in fields."""

    def turns(r: Record) -> Column:
        before = F.flatten(F.transform(r.get(path, "array<array<string>>"), lambda p: F.array(_turn(F.lit("user"), F.get(p, 0)), _turn(F.lit("assistant"), F.get(p, 1)))))
        return F.concat(F.coalesce(before, F.array().cast(TURNS)), last(r))

    return turns


def row(turn: str, role: str, text: str) -> Callable[[Record], Column]:
    """Mapping of a record that is one turn of a conversation."""
    return lambda r: F.array(_turn(r.get(role, "string"), r.get(text, "string"), r.get(turn, "bigint")))


#: Layouts by their field paths, sorted, and the mapping of their records to turns.
LAYOUTS: dict[tuple[str, ...], Callable[[Record], Column]] = {
    ("conv_id", "role", "text", "turn"): row("turn", "role", "text"),
    ("content", "conversation_id", "position", "role"): row("position", "role", "content"),
    ("completion", "prompt"): fields(("prompt", "user"), ("completion", "assistant")),
    ("prompt", "response"): fields(("prompt", "user"), ("response", "assistant")),
    ("prompt", "response", "system"): fields(("system", "system"), ("prompt", "user"), ("response", "assistant")),
    ("answer", "question"): fields(("question", "user"), ("answer", "assistant")),
    ("instruction", "output"): fields(("instruction", "user"), ("output", "assistant")),
    ("input", "instruction", "output"): fields(("instruction", "user"), ("output", "assistant"), second_paragraph="input"),
    ("messages",): items("messages", "role", "content"),
    ("messages", "messages[].content", "messages[].role"): items("messages", "role", "content"),
    ("conversations",): items("conversations", "from", "value"),
    ("conversations", "conversations[].from", "conversations[].value"): items("conversations", "from", "value", human="user", gpt="assistant"),
    ("history", "prompt", "response"): pairs("history", fields(("prompt", "user"), ("response", "assistant"))),
}
KNOWN = {p for paths in LAYOUTS for p in paths}
LISTS = sorted({p.split("[]")[0] for p in KNOWN if "[]" in p})
#: Fields that hold the conversation a row belongs to.
CONVERSATION = ("conv_id", "conversation_id")


def to_turns(df: DataFrame, record: str, layouts: dict[tuple[str, ...], Callable[[Record], Column]] = LAYOUTS) -> DataFrame:
    """df with `layout` (fingerprint) and `turns` of the column `record`: a struct, a variant, or JSON text.

    A layout fits if the hash of those of its paths that the record has is its fingerprint; of several, the one with the most paths counts.
    """
    kind = df.schema[record].dataType
    if isinstance(kind, T.StringType):
        df, kind = df.withColumn(record, F.try_parse_json(record)), T.VariantType()
    r = Record(F.col(record), kind)
    df = df.withColumn("_paths", r.paths())
    layout, turns = fingerprint(F.col("_paths")), F.array().cast(TURNS)
    for paths, mapping in sorted(layouts.items(), key=lambda x: len(x[0])):
        if isinstance(kind, T.StructType) and not {p.split("[]")[0] for p in paths} <= set(kind.fieldNames()):
            continue  # the mapping can't be read from this type
        all_paths = F.array(*[F.lit(p) for p in paths])
        fits = fingerprint(F.array_intersect(F.col("_paths"), all_paths)) == fingerprint(all_paths)
        layout, turns = F.when(fits, fingerprint(all_paths)).otherwise(layout), F.when(fits, mapping(r).cast(TURNS)).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": F.coalesce(turns, F.array().cast(TURNS))}).drop("_paths")


def from_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, layout, turns) of a column of JSON records."""
    return to_turns(df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record")), "record").select("conv_id", "layout", "turns")


def from_table(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with a row for each turn: each row is a record."""
    rows = {paths: mapping for paths, mapping in LAYOUTS.items() if set(paths) & set(CONVERSATION) and set(paths) <= set(df.columns)}
    if not rows:
        raise ValueError(f"no mapping for the columns {sorted(df.columns)}")
    paths, mapping = next(iter(rows.items()))  # of several that fit, the first counts
    conversation = next(c for c in CONVERSATION if c in paths)
    rows = to_turns(df.select(F.col(conversation).alias("conv_id"), F.struct(*paths).alias("record")), "record", {paths: mapping})
    turn = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return rows.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list(turn)), _by_turn).alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    def step(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x.eqNullSafe(y), rest).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    return step(a["turn"], b["turn"], step(a["role"], b["role"], step(a["text"], b["text"], F.lit(0))))


def format_turns(df: DataFrame, turns: str = "turns", learned_role: str = "assistant") -> DataFrame:
    """Adds `segments` (array of text and loss flag) and `formatted`, the segments in a row."""

    def segments(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(NAMED)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), F.coalesce(t["role"] == learned_role, F.lit(False)).alias("loss")),
            F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
        )

    out = df.withColumn("segments", F.flatten(F.transform(turns, segments)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    records = F.filter(F.split(formatted, CLOSE, -1), lambda r: r != "")

    def turn(r: Column) -> Column:
        body = F.substr(r, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, NAMED, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + len(NAMED) + 1)).alias("text"))

    return F.transform(records, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"), "role", F.lit(own).alias("text"))
    rows = table(spark, sf_dir, "conversations").unionByName(extra, allowMissingColumns=True)
    done = format_turns(from_table(rows)).select("conv_id", "segments", "formatted")
    read = done.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(role) + length(text) + 20
  + length(text) - length(replace(text, '\', '')) + length(role) - length(replace(role, '\', ''))
  + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(chars) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
