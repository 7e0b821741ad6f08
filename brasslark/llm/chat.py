"""Chat formatting: layouts told by a hash of their nested field paths, declarative mappings to turns, and a reversible template.

A record is a VARIANT. Of all field paths that some mapping names, those that the record has are sorted and hashed; the
hash selects the mapping, and fields that no mapping names do not count. A mapping lists parts: a list of messages with
the paths of role and text in each, a list of exchanges, or fields that make one turn. Spark evaluates it; no record passes Python.

The template writes `### role: text</turn>` and a line feed. In roles and texts a backslash goes before each backslash and each
control string (in roles before a colon, too), so a reader finds its marks only where the template wrote them.

Records, turns and texts may be null: a null text or role is empty, a null conversation id is an id of its own. Turns are
placed by `turn` (null first, then by role and text), repeated rows are turns of their own, and no rows give no
conversations. A conversation may be longer than a task's memory: it is written in segments of SEGMENT turns, and digests
go over its segments one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.llm.common import saved
from brasslark.operators.scans import placed

#: Turns of a segment.
SEGMENT = 256
TURNS = "array<struct<place: long, role: string, text: string>>"
#: Other layouts' names of the three roles.
ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "ai": "assistant", "developer": "system"}


class Listed(NamedTuple):
    """A list of messages: the paths of each one's role and text. With `parts`, a text is itself a list of pieces."""

    path: str
    role: str
    text: str
    parts: str = ""

    def paths(self) -> list[str]:
        return [f"{self.path}[].{self.role}", f"{self.path}[].{self.text}" + (f"[].{self.parts}" if self.parts else "")]

    def turns(self, record: Column) -> Column:
        def text(x: Column) -> Column:
            if not self.parts:
                return _string(x, self.text)
            return F.array_join(F.transform(F.try_variant_get(x, f"$.{self.text}", "array<variant>"), lambda p: F.coalesce(_string(p, self.parts), F.lit(""))), "")

        each = F.try_variant_get(record, f"$.{self.path}", "array<variant>")
        return F.transform(each, lambda x, i: F.struct(i.cast("long").alias("place"), _role(_string(x, self.role)).alias("role"), text(x).alias("text")))


class Exchanges(NamedTuple):
    """A list of [asked, answered]."""

    path: str

    def paths(self) -> list[str]:
        return [f"{self.path}[][]"]

    def turns(self, record: Column) -> Column:
        each = F.try_variant_get(record, f"$.{self.path}", "array<array<string>>")
        turn = lambda x, i, k, role: F.struct((i * 2 + k).cast("long").alias("place"), F.lit(role).alias("role"), F.get(x, F.lit(k)).alias("text"))
        return F.flatten(F.transform(each, lambda x, i: F.array(turn(x, i, 0, "user"), turn(x, i, 1, "assistant"))))


class Said(NamedTuple):
    """One turn of a role that some fields make, an empty line between; no turn if the record has none of them."""

    role: str
    fields: tuple[str, ...]

    def paths(self) -> list[str]:
        return list(self.fields)

    def turns(self, record: Column) -> Column:
        text = F.concat_ws("\n\n", *[F.nullif(_string(record, f), F.lit("")) for f in self.fields])
        there = reduce(lambda a, b: a | b, (_has(record, f) for f in self.fields))
        return F.when(there, F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(self.role).alias("role"), text.alias("text")))).otherwise(F.array().cast(TURNS))


class Row(NamedTuple):
    """A record that is itself one turn of a conversation of several rows."""

    place: str
    role: str
    text: str

    def paths(self) -> list[str]:
        return [self.place, self.role, self.text]

    def turns(self, record: Column) -> Column:
        place = F.try_variant_get(record, f"$.{self.place}", "long")
        return F.array(F.struct(place.alias("place"), _string(record, self.role).alias("role"), _string(record, self.text).alias("text")))


class Layout(NamedTuple):
    """parts in their order; a record may lack any of the paths in optional."""

    name: str
    parts: tuple[Listed | Exchanges | Said | Row, ...]
    optional: tuple[str, ...] = ()

    def shapes(self) -> Iterator[list[str]]:
        """The sets of paths that are this layout."""
        needed = {p for part in self.parts for p in part.paths()} - set(self.optional)
        for n in range(len(self.optional) + 1):
            for some in combinations(self.optional, n):
                yield sorted(needed | set(some))


_SYSTEM = Said("system", ("system",))
LAYOUTS = (
    Layout("turn rows", (Row("turn", "role", "text"),)),
    Layout("messages", (_SYSTEM, Listed("messages", "role", "content")), ("system",)),
    Layout("messages of parts", (_SYSTEM, Listed("messages", "role", "content", "text")), ("system",)),
    Layout("from and value", (_SYSTEM, Listed("conversations", "from", "value")), ("system",)),
    Layout("instruction", (_SYSTEM, Exchanges("history"), Said("user", ("instruction", "input")), Said("assistant", ("output",))), ("system", "input", "history[][]")),
    Layout("prompt and completion", (_SYSTEM, Said("user", ("prompt",)), Said("assistant", ("completion",))), ("system",)),
    Layout("prompt and response", (_SYSTEM, Said("user", ("prompt",)), Said("assistant", ("response",))), ("system",)),
    Layout("question and answer", (_SYSTEM, Said("user", ("context", "question")), Said("assistant", ("answer",))), ("system", "context")),
    Layout("prompt messages", (Listed("prompt", "role", "content"), Listed("completion", "role", "content"))),
)


def _string(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _role(c: Column) -> Column:
    named = F.lower(F.trim(c))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), named), c)


def _has(record: Column, path: str) -> Column:
    """Whether a record has a path; `[]` is the first element of a list."""
    return F.try_variant_get(record, f"$.{path.replace('[]', '[0]')}", "variant").isNotNull()


def _known(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for part in layout.parts for p in part.paths()})


def _hash(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """SHA-256 of the sorted field paths of a record, of those that a layout names. A field that is null is there."""
    known = _known(layouts)
    # a path that leads into a list stands for itself; a list of lists or objects isn't a plain field too
    plain = [p for p in known if not any(q.startswith(f"{p}[]") for q in known)]
    present = [F.when(_has(record, p), F.lit(p)) if p in plain else F.when(_has(record, p) & ~_has(record, f"{p}[]"), F.lit(p)) for p in known]
    return F.sha2(F.array_join(F.array_compact(F.array(*present)), "\n"), 256)


def mapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records (conv_id, record VARIANT) with fingerprint and layout; layout is null where no mapping has the fingerprint."""
    names = {_hash(shape): layout.name for layout in layouts for shape in layout.shapes()}
    rows = records.select("conv_id", "record", fingerprint(F.col("record"), layouts).alias("fingerprint"))
    return rows.withColumn("layout", F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("fingerprint")))


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, part, place, role, text): the turns of the records that have a layout; `unmapped` gives the others."""
    rows = mapped(records, layouts)
    empty = F.array().cast("array<struct<part: int, place: long, role: string, text: string>>")

    def numbered(part: int, turns: Column) -> Column:
        return F.transform(F.coalesce(turns, F.array().cast(TURNS)), lambda t: F.struct(F.lit(part).alias("part"), t["place"].alias("place"), t["role"].alias("role"), t["text"].alias("text")))

    def all_turns(layout: Layout) -> Column:
        return F.concat(*[numbered(k, part.turns(F.col("record"))) for k, part in enumerate(layout.parts)])

    turns = reduce(lambda rest, layout: F.when(F.col("layout") == layout.name, all_turns(layout)).otherwise(rest), layouts, empty)
    return rows.where("layout is not null").select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.*")


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, n, example): layouts that have no mapping, how many records have each, and the smallest conv_id."""
    return mapped(records, layouts).where("layout is null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("example"))


class Template(NamedTuple):
    """Marks of a turn. The first character of each control string is not the escape."""

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>"
    end: str = "\n"
    escape: str = "\\"

    @property
    def controls(self) -> list[str]:
        return [self.escape, self.open.strip(), self.close]

    def escaped(self, text: Column, more: tuple[str, ...] = ()) -> Column:
        pattern = "|".join(f"\\Q{c}\\E" for c in (*self.controls, *more))
        return F.regexp_replace(text, f"({pattern})", "\\\\$1" if self.escape == "\\" else self.escape + "$1")

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def reader(self) -> re.Pattern[str]:
        """One turn as written: role and text, still escaped."""
        esc, first, rest = re.escape(self.escape), re.escape(self.close[0]), re.escape(self.close[1:])
        role = f"[^{esc}{re.escape(self.colon[0])}]*(?:{esc}.[^{esc}{re.escape(self.colon[0])}]*)*"
        text = f"[^{esc}{first}]*(?:(?:{esc}.|{first}(?!{rest}))[^{esc}{first}]*)*"
        return re.compile(f"{re.escape(self.open)}({role}){re.escape(self.colon)}({text}){re.escape(self.close)}{re.escape(self.end)}", re.DOTALL)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted text; an error if there is anything else in it."""
        reader, at, out = self.reader(), 0, []
        while at < len(formatted):
            m = reader.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescaped(m[1]), self.unescaped(m[2])))
            at = m.end()
        return out


def formatted(turns: DataFrame, template: Template = Template(), loss_role: str = "assistant", segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, formatted, loss): each conversation as text, in segments that follow each other without anything between.

    loss has the spans (from, to, in code points of the segment) of the escaped texts that a model is trained on.
    """
    rows = turns.select("conv_id", "part", "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("part"), F.col("place").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = placed(rows, ["conv_id"], order, "at").withColumn("segment", F.floor((F.col("at") - 1) / segment))
    head = F.concat(F.lit(template.open), template.escaped(F.col("role"), (template.colon[0],)), F.lit(template.colon))
    rows = rows.withColumn("head", head).withColumn("body", template.escaped(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(template.close + template.end)))
    earlier = Window.partitionBy("conv_id", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(earlier), F.lit(0)) + F.char_length("head")
    rows = rows.select("conv_id", "segment", "at", "piece", (F.col("role") == loss_role).alias("learned"), start.alias("from"), (start + F.char_length("body")).alias("to"))
    each = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "learned", "from", "to"))).alias("all"))
    spans = F.transform(F.filter("all", lambda x: x["learned"]), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to")))
    return each.select("conv_id", "segment", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def digests(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation of formatted: what a reader gets back from its text and spans alone.

    conv_id, n_turns, turns_sha256 (over role, line feed, text, line feed of each turn), loss_chars, loss_sha256 (over
    all text under the spans, unescaped), formatted_chars. Segments of a conversation stream by; none is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now: list | None = None

        def rows(done: list[list]) -> pa.RecordBatch:
            columns = zip(*[(c, n, t.hexdigest(), k, l.hexdigest(), f) for c, n, t, k, l, f in done], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.string() if i in (2, 4) else pa.int64()) for i, x in enumerate(columns)], names)

        for b in batches:
            done = []
            for conv, text, spans in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = template.turns(text)
                now[1] += len(found)
                for role, said in found:
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    said = template.unescaped(text[s["from"] : s["to"]])
                    now[3] += len(said)
                    now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    ordered = texts.select(F.col("conv_id").cast("long").alias("conv_id"), "segment", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(rows: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as records; its other columns are not looked at."""
    own = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.to_variant_object(own).alias("record"))


def written(records: DataFrame, template: Template = Template()) -> DataFrame:
    """records formatted and written to the shared folder: what is read back is what was written."""
    return saved(formatted(canonical(records), template), "chat")
