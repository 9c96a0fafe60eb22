"""SQL scripts: CREATE TABLE / VIEW, INSERT, SET and SELECT over connector tables, on bounded data and on streams.

On bounded data a changelog table stands for the rows that it leaves, so that every aggregate, also one over another aggregate, counts what has
been retracted out. On streams (live=True) tables of files are read as streams with their watermark; start() runs every INSERT to the
end of what there is: windowed and plain results in append mode, updating ones as a changelog by the sink's primary key."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import debezium, updating
from ..sources import connectors, formats
from ..streaming import runner, stateful
from ..types import spark_type, split_top
from ..operators.windows import micros
from . import live
from .rewrite import TIME, carry_time, rewrite
from .validate import LOOKUP, PLAIN, UPDATING, PlanError, check_plan, check_select, check_sink, check_watermark


@dataclass
class Table:
    name: str
    fields: list[T.StructField] = field(default_factory=list)
    generated: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    watermark: tuple[str, str | None] | None = None
    partitions: list[str] = field(default_factory=list)
    temporary: bool = False

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.fields if f.name not in self.generated and f.name not in self.metadata])


def statements(script: str) -> list[str]:
    script = re.sub(r"('(?:[^']|'')*')|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", script, flags=re.S)
    return split_top(script, ";")


def parse_table(sql: str) -> Table:
    m = re.match(r"(?is)create\s+(temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?[`\"]?(\w+)[`\"]?\s*\(", sql)
    if not m:
        raise PlanError(f"can't parse: {sql[:60]}")
    depth, i = 1, m.end()
    while depth:
        depth += (sql[i] == "(") - (sql[i] == ")")
        i += 1
    t, rest = Table(m[2].lower(), temporary=bool(m[1])), sql[i:]
    for part in split_top(sql[m.end() : i - 1]):
        if w := re.match(r"(?is)watermark\s+for\s+(\w+)(?:\s+as\s+(.+))?$", part):
            if t.watermark:
                raise PlanError("only one watermark is allowed for a table")
            kind = next((f.dataType.simpleString() for f in t.fields if f.name == w[1]), None)
            if kind is None:
                raise PlanError(f"no column {w[1]} for the watermark")
            check_watermark(kind)
            t.watermark = (w[1], w[2])
            continue
        if k := re.match(r"(?is)primary\s+key\s*\((.+)\)$", part):
            t.keys = [x.strip() for x in k[1].split(",")]
            continue
        c = re.match(r"(?is)[`\"]?(\w+)[`\"]?\s+(.*?)(?=\s+(?:not\s+null|null|primary\s+key|generated\s+always|metadata\b)|$)(.*)$", part)
        if not c:
            raise PlanError(f"can't parse column: {part}")
        name, tail = c[1], c[3]
        t.fields.append(T.StructField(name, spark_type(c[2]), not re.search(r"(?i)not\s+null", tail)))
        if g := re.search(r"(?is)generated\s+always\s+as\s*\((.+)\)\s*(?:stored)?\s*$", tail):
            t.generated[name] = g[1]
        if d := re.search(r"(?is)metadata\s+from\s+'([^']+)'|metadata\s*\(\s*'([^']+)'\s*\)", tail):
            t.metadata[name] = d[1] or d[2]
        if re.search(r"(?i)primary\s+key", tail):
            t.keys.append(name)
    if p := re.search(r"(?is)partitioned\s+by\s*\((.*?)\)\s*(?:with|$)", rest):
        t.partitions = split_top(p[1])
    if w := re.search(r"(?is)\bwith\s*\((.*)\)\s*$", rest):
        for pair in split_top(w[1]):
            k, _, v = pair.partition("=")
            t.options[k.strip().strip("'\"`").lower()] = v.strip().strip("'")
    if t.options.get("format") == "debezium_json":
        if t.generated:
            raise PlanError("updating tables can't have virtual fields")
        if "event_time_field" in t.options:
            raise PlanError("updating tables can't have an event_time_field")
        if not t.keys and t.options.get("type", "source") == "source":
            raise PlanError("debezium tables need a PRIMARY KEY")
    if t.options.get("connector", "memory") == "memory" and (t.generated or set(t.options) - {"connector"}):
        raise PlanError("memory tables take neither options nor virtual fields")
    connectors.check(t.options)
    return t


class Engine:
    """Runs scripts; tables live in this object, views in the session. inputs: DataFrames in place of connectors."""

    def __init__(self, spark: SparkSession, inputs: dict[str, DataFrame] | None = None, streaming: bool = True, live: bool = False):
        """streaming: keep the dialect's rules (False allows the batch extensions). live: read connectors as streams."""
        self.spark, self.inputs, self.streaming, self.live = spark, {k.lower(): v for k, v in (inputs or {}).items()}, streaming, live
        #: tables and views whose rows aren't plain
        self.kinds: dict[str, str] = {}
        #: views that leave event time out: as they are, and with it
        self.views: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.sink_kinds: dict[str, str] = {}
        self.tables: dict[str, Table] = {}
        self.settings: dict[str, str] = {"updating_ttl": "1 day"}
        self.sinks: dict[str, DataFrame] = {}

    def _scan(self, t: Table) -> DataFrame:
        df = self.inputs[t.name] if t.name in self.inputs else connectors.read(self.spark, t.options, t.schema, stream=self.live, metadata=t.metadata)
        if t.options.get("format") == "debezium_json":
            names = [f.name for f in t.schema.fields]
            self.kinds[t.name] = UPDATING
            if df.isStreaming:
                return debezium.unroll(df, t.keys).select(*names)  # start() carries the retractions up
            df = updating.live_rows(debezium.unroll(df, t.keys), names)
        elif t.temporary:
            self.kinds[t.name] = LOOKUP
        for f in t.fields:
            if f.name in t.metadata and f.name in df.columns:
                df = df.withColumn(f.name, F.col(f.name).cast(f.dataType))
        for name, expr in t.generated.items():
            df = df.withColumn(name, F.expr(rewrite(expr)).cast(next(f.dataType for f in t.fields if f.name == name)))
        at = t.options.get("event_time_field") or (t.watermark[0] if t.watermark else None) or next((f.name for f in t.fields if isinstance(f.dataType, T.TimestampType)), None)
        if not at or TIME in df.columns:
            return df
        df = df.withColumn(TIME, F.col(at))
        return runner.with_event_time(df, TIME, self._delay(t)) if df.isStreaming else df

    @staticmethod
    def _delay(t: Table) -> str:
        """How far the watermark stays behind event time: what its expression takes off the column, by default one second."""
        if not t.watermark or not t.watermark[1]:
            return "1 second"
        m = re.fullmatch(rf"(?is)\(?\s*{t.watermark[0]}\s*(?:-\s*interval\s*'?([^']+?)'?\s*(\w+)?)?\s*\)?", t.watermark[1])
        if not m:
            raise PlanError(f"the watermark must be {t.watermark[0]} less an interval")
        delay = f"{m[1]} {m[2] or ''}".strip() if m[1] else "0 seconds"
        micros(delay)
        return delay

    def _timed(self, sql: str) -> DataFrame:
        """The query with event time carried through lists and views that leave it out."""
        for name, (_, timed) in self.views.items():
            timed.createOrReplaceTempView(name)
        try:
            return self.spark.sql(rewrite(carry_time(sql)))
        finally:
            for name, (df, _) in self.views.items():
                df.createOrReplaceTempView(name)

    def _planned(self, sql: str) -> tuple[DataFrame, str]:
        check_select(sql, self.streaming)
        try:
            df = self.spark.sql(rewrite(sql))
        except AnalysisException as e:
            if TIME not in str(e):
                raise
            df = self._timed(sql)
        return df, check_plan(df, self.kinds) if self.streaming else PLAIN

    def _view(self, name: str, sql: str) -> None:
        df, kind = self._planned(sql)
        df.createOrReplaceTempView(name)
        self.views.pop(name.lower(), None)
        self.kinds.pop(name.lower(), None)
        if kind != PLAIN:
            self.kinds[name.lower()] = kind
        elif TIME not in df.columns:
            try:
                self.views[name.lower()] = (df, self._timed(sql))
            except AnalysisException:
                pass  # its inputs have no event time

    def query(self, sql: str) -> DataFrame:
        return self._planned(sql)[0].drop(TIME)

    def run(self, script: str) -> list[DataFrame]:
        """Results of bare SELECTs, in order; INSERTs go to self.sinks and to their connectors on flush()."""
        out, found = [], statements(script)
        if not found:
            raise PlanError("the script is empty")
        for s in found:
            if m := re.match(r"(?is)set\s+(\w+)\s*=\s*(?:interval\s+)?'?([^']+?)'?\s*(\w+)?$", s):
                if m[1].lower() != "updating_ttl":
                    raise PlanError(f"unknown variable {m[1]}")
                self.settings["updating_ttl"] = f"{m[2]} {m[3] or ''}".strip()
            elif m := re.match(r"(?is)create\s+(?:or\s+replace\s+)?(?:view|table)\s+(\w+)\s+as\s+(.*)$", s):
                self._view(m[1], m[2])
            elif re.match(r"(?i)create\b", s):
                t = parse_table(s)
                self.tables[t.name] = t
                if t.options.get("connector", "memory") != "memory" and t.options.get("type") != "sink" and connectors.SOURCES.get(t.options["connector"]):
                    self._scan(t).createOrReplaceTempView(t.name)
            elif m := re.match(r"(?is)insert\s+into\s+(\w+)\s*(?:\(([^)]*)\))?\s*(.*)$", s):
                df, kind = self._planned(m[3])
                self._insert(m[1].lower(), df.drop(TIME), kind)
            elif re.match(r"(?i)(select|with|values)\b", s):
                out.append(self.query(s))
            else:
                check_select(s, self.streaming)
                raise PlanError(f"unsupported statement: {s[:40]}")
        if not out and not self.sinks:
            raise PlanError("the script contains no query")
        return out

    def _insert(self, name: str, df: DataFrame, kind: str) -> None:
        if name not in self.tables:
            raise PlanError(f"unknown table {name}")
        t = self.tables[name]
        check_sink(kind == UPDATING or "_updating_meta" in df.columns, t.options.get("format", "json") if t.options.get("connector", "memory") != "memory" else "debezium_json")
        if len(df.columns) != len(t.schema.fields) and t.schema.fields:
            raise PlanError(f"{name} has {len(t.schema.fields)} columns, the query has {len(df.columns)}")
        df = df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, t.schema.fields)]) if t.schema.fields else df
        if t.options.get("format") == "debezium_json" and "op" not in df.columns and not df.isStreaming:
            df = debezium.to_debezium(df)
        self.sinks[name] = self.sinks[name].union(df) if name in self.sinks else df
        self.sink_kinds[name] = kind
        if not t.options or t.options.get("connector") == "memory":
            self.sinks[name].createOrReplaceTempView(name)
            if kind != PLAIN:
                self.kinds[name] = kind

    def start(self, checkpoint: str) -> None:
        """Runs every streaming INSERT over all there is, with its progress and state under checkpoint; a second call goes on from there."""
        for name, df in self.sinks.items():
            t = self.tables[name]
            if t.options.get("connector") not in ("filesystem", "single_file"):
                raise PlanError("streaming results go to file sinks")
            at, form = f"{checkpoint}/{name}", lambda df, o=t.options: formats.plain(df, o)
            if self.sink_kinds[name] == UPDATING:
                if not t.keys:
                    raise PlanError(f"{name} needs a PRIMARY KEY to keep an updating result")
                try:
                    rows = live.with_state(df, self.settings["updating_ttl"])
                except PlanError:
                    if live.reads_changelog(df):
                        raise
                    # functions without a form with state: the engine's own, compared with what was written; Spark refuses one over another
                    sink = runner.updating_to_changelog(f"{at}/rows", t.options["path"], t.keys, fmt="json", form=form)
                    runner.run_to_end(df, f"{at}/progress", sink, "update")
                else:
                    runner.run_to_end(rows, f"{at}/progress", stateful.to_changelog(t.options["path"], t.keys, "json", form), empty_batches=False)
            else:
                kind = t.options.get("format")
                out = (lambda df, form=form: form(debezium.to_debezium(df))) if kind == "debezium_json" else None if kind == "parquet" else form
                runner.run_to_end(df, f"{at}/progress", runner.to_table(t.options["path"], out, "parquet" if kind == "parquet" else "json"))

    def flush(self) -> None:
        """Writes every sink once; inserts into one sink have been merged."""
        for name, df in self.sinks.items():
            if self.tables[name].options.get("connector", "memory") != "memory":
                connectors.write(df, self.tables[name].options, self.tables[name].partitions)
