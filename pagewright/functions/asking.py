"""Row-local work that needs a lexicon too large for any worker: decisions are asked for, and joins answer.

Which words a page looks up depends on what it learns: a reading is known or it is not, and then its other spellings count. So
the work runs with the decisions (ocrtext.Reader) that a row was told. A decision that no lexicon bears on is made where it comes
up; another one is noted, and stands meanwhile as if no word were known. The distinct decisions that all rows lack are made once,
whatever the rows that want them, and only those that come out otherwise than without a lexicon travel back. Rows that noted any
run again; a row without new ones is done. A row asks for a decision once, so the rounds end; rows that are done are not run again.

A decision is made in the same way from words: it runs with the frequencies that it was told, the words that it lacks are answered
by a join with (lang, word, zipf), and it runs again.

Nothing is collected and nothing has a limit: a lexicon is a table like any other, and frequent words are rows of a join that
Spark may split. The lexicon, as often as it is asked, is worked out once. Each round is a written table in the folder of
spark.checkpoint.dir, so a lost executor costs its own tasks.
"""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ocrtext import CLOSERS, CONFUSED, OPENERS, SLOTS, Reader, as_cyrillic, as_latin, cut_edges


class Languages(NamedTuple):
    """A lexicon (lang, word, zipf) and its Cyrillic and Latin languages; without a table no word is known."""

    table: DataFrame | None = None
    cyr: str | None = None
    lat: str | None = None


class Told:
    """The frequencies that a decision was told, as a mapping that notes what else it is asked for."""

    def __init__(self):
        self.known: dict[str, float] = {}
        self.asked: set[str] = set()
        self.new: set[str] = set()

    def get(self, word: str, default: float = 0.0) -> float:
        found = self.known.get(word)
        if found is not None:
            return found
        if word not in self.asked:
            self.new.add(word)
        return default


class _Blank:
    """A lexicon without words that tells whether it was asked."""

    asked = False

    def get(self, word: str, default: float = 0.0) -> float:
        self.asked = True
        return default


class _Bare(Reader):
    """The decisions where no word is known; a word whose letters allow no other spelling asks nothing."""

    def recover_cyr(self, w: str) -> str | None:
        return super().recover_cyr(w) if all(map(as_cyrillic, cut_edges(w)[1])) else None

    def recover_lat(self, w: str) -> str | None:
        return super().recover_lat(w) if all(map(as_latin, cut_edges(w)[1])) else None

    def repair(self, w: str) -> str | None:
        doubtful = sum(ch in CONFUSED for ch in w.lstrip(OPENERS).rstrip(CLOSERS))
        return super().repair(w) if 1 <= doubtful <= SLOTS else None


class _Unkept(dict):
    def __setitem__(self, key, value):
        pass


#: Bytes of an Arrow batch at most about: the words of a batch's pages are Python objects at one time.
ARROW_BYTES, _ARROW = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Decisions without a lexicon that a worker keeps.
FREE = 1 << 17


@lru_cache(FREE)
def _free(work: Callable, asked: tuple):
    """(What a decision is where no word is known, whether a lexicon was asked for it)."""
    blank = _Blank()
    reader = _Bare(blank, blank)
    reader.held = _Unkept()  # a kept decision would not ask again
    own = getattr(reader, work.__name__)
    return own(*asked), blank.asked


class _Answers(dict):
    """The decisions of one row after the other, by what each was told (turn); new are those that the row lacks. Only decisions
    that no lexicon bears on are held from row to row."""

    def turn(self, told: dict[str, str], asked: set[str]) -> None:
        self.told, self.asked, self.new, self.open = told, asked, set(), {}

    def __missing__(self, key):
        if key in self.open:
            return self.open[key]
        found, open_ = _free(*key)
        if not open_:
            if len(self) >= FREE:
                self.clear()
            self[key] = found
            return found
        q = _question(*key)
        if q in self.told:
            found = json.loads(self.told[q])
        elif q not in self.asked:
            self.new.add(q)
        self.open[key] = found
        return found


def _question(work: Callable, asked: tuple) -> str:
    return json.dumps([work.__name__, *asked], ensure_ascii=False)


class _Asking(Reader):
    """A reader whose lexicon is elsewhere."""

    def __init__(self, answers: _Answers):
        super().__init__({}, {})
        self.held = answers

    def zc(self, w: str) -> float:
        return self.held[Reader.zc, (w,)]

    def zl(self, w: str) -> float:
        return self.held[Reader.zl, (w,)]


def _made(q: str, reader: Reader) -> str | None:
    """The answer to a question, null if it is the one without a lexicon."""
    name, *asked = json.loads(q)
    work = getattr(Reader, name)
    found = work(reader, *asked)
    free, _ = _free(work, tuple(asked))
    return None if found == free else json.dumps(found, ensure_ascii=False)


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


_WORD, _DECISION = _of(("cyr", T.BooleanType()), ("word", T.StringType())), _of(("q", T.StringType()))
_ZIPF, _ANSWER = T.StructField("zipf", T.DoubleType()), T.StructField("a", T.StringType())


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own, in local sessions alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _unpacked(column: pa.Array) -> list:
    """The values of a column; lists of structs are read field by field, not value by value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        flat = column.flatten()
        each = _unpacked(flat)
        sizes = pc.list_value_length(column).to_pylist()
        out, at = [], 0
        for n in sizes:
            out.append(None if n is None else each[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(column.type) and not column.null_count:
        names = [f.name for f in column.type]
        return [dict(zip(names, values, strict=True)) for values in zip(*map(_unpacked, column.flatten()), strict=True)]
    if pa.types.is_string(column.type) or (pa.types.is_floating(column.type) or pa.types.is_integer(column.type)) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _packed(rows: list, kind: pa.DataType) -> pa.Array:
    """Rows as a column; lists of tuples are laid out field by field."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)) or any(r is None for r in rows):
        return pa.array(rows, kind)
    flat = [x for r in rows for x in r]
    fields = zip(*flat, strict=True) if flat else [()] * kind.value_type.num_fields
    columns = [pa.array(values, f.type) for values, f in zip(fields, kind.value_type, strict=True)]
    offsets = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)


class _Unlearned(Reader):
    """The reader that knows no word: no spelling is frequent enough, so none is tried."""

    def __init__(self):
        super().__init__({}, {})

    def _likeliest(self, ways, frequency, least: float) -> None:
        return None

    def repair(self, w: str) -> None:
        return None


def _alone(work, names: list[str], keys: list[str], kind: pa.DataType, plain: Callable | None = None):
    """Keys and the result of work(row, reader) where nobody answers: one reader, which knows no word, serves all rows but those
    whose results plain(batch, kind) gives, as (which rows, their results)."""

    def run(batches):
        reader = _Unlearned()
        for b in batches:
            if plain is not None:
                done, results = plain(b, kind)
                if len(results):
                    yield pa.RecordBatch.from_arrays([*(b.column(k).filter(done) for k in keys), results], [*keys, "result"])
                b = b.filter(pc.invert(done))
                if not b.num_rows:
                    continue
            rows = zip(*(_unpacked(b.column(n)) for n in names), strict=True)
            results = [work(dict(zip(names, values, strict=True)), reader) for values in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), _packed(results, kind)], [*keys, "result"])

    return run


def _by_decisions(work):
    """Steps of _rounds by work(row, reader): (result, the decisions that the row lacks)."""

    def steps():
        answers = _Answers()
        reader = _Asking(answers)

        def step(row, told, asked):
            answers.turn({x["q"]: x["a"] for x in told}, {x["q"] for x in asked})
            out = work(row, reader)
            return out, [{"q": q} for q in sorted(answers.new)]

        return step

    return steps


def _by_words():
    """Steps of _rounds for questions: (the answer, the words that it lacks)."""

    def step(row, told, asked):
        cyr, lat = Told(), Told()
        for x in told:
            known = (cyr if x["cyr"] else lat).known
            known[x["word"]] = max(x["zipf"], known.get(x["word"], 0.0))
        for x in asked:
            (cyr if x["cyr"] else lat).asked.add(x["word"])
        out = _made(row["q"], Reader(cyr, lat))
        return out, [{"cyr": side is cyr, "word": w} for side in (cyr, lat) for w in sorted(side.new)]

    return step


@contextmanager
def _acyclic():
    """Without the search for cycles, of which the rows of a page have none and which takes as long as the work on them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _run(steps, names: list[str], keys: list[str], schema: T.StructType):
    """Rows with their result, and nothing else, or with what they lack."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    listed = pa.types.is_list(kinds["result"])

    def run(batches):
        step = steps()
        for b in batches:
            results, asked, new = [], [], []
            with _acyclic():
                rows = zip(*(_unpacked(b.column(n)) for n in names), strict=True)
                for values, told, before in zip(rows, _unpacked(b.column("told")), _unpacked(b.column("asked")), strict=True):
                    out, lacks = step(dict(zip(names, values, strict=True)), told, before)
                    results.append(([] if listed else None) if lacks else out)
                    new.append(lacks)
                    asked.append(before + lacks if lacks else [])
            still = pa.array([bool(x) for x in new], pa.bool_())
            kept = [b.column(n) if n in keys else pc.if_else(still, b.column(n), pa.scalar(None, b.column(n).type)) for n in (*names, "told")]
            made = [pa.array(x, kinds[n]) for x, n in ((asked, "asked"), (new, "new"))] + [_packed(results, kinds["result"])]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "told", "asked", "new", "result"])

    return run


def _rounds(rows: DataFrame, keys: list[str], steps, result: T.DataType, question: T.StructType, answer: T.StructField, lookup) -> DataFrame:
    """(keys, result) of every row: rows run by steps, and as long as they lack anything, lookup adds answers to (keys, question)."""
    asks, tells = T.ArrayType(question), T.ArrayType(T.StructType([*question.fields, answer]))
    held = [f if f.name in keys else T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    schema = T.StructType([*held, *_of(("told", tells), ("asked", asks), ("new", asks), ("result", result)).fields])
    run = _run(steps, rows.columns, keys, schema)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = rows.withColumns({"told": F.array().cast(tells), "asked": F.array().cast(asks)})
    done = None
    while True:
        out = written(state.mapInArrow(run, schema))
        ready = out.where(F.size("new") == 0).select(*keys, "result")
        done = ready if done is None else done.unionByName(ready)
        still = out.where(F.size("new") > 0)
        if still.isEmpty():
            return done
        wanted = still.select(*keys, F.explode("new").alias("x")).select(*keys, "x.*")
        answers = lookup(wanted).groupBy(*keys).agg(F.collect_list(F.struct(*question.names, answer.name)).alias("more"))
        # Dealt by number: the work on a row costs far more than its bytes tell.
        both = still.repartition(n, *keys).join(answers, keys, "left")
        state = both.select(*rows.columns, F.concat("told", F.coalesce("more", F.array().cast(tells))).alias("told"), "asked")


#: A side of a join is broadcast only if it was counted and its rows' characters stay below this many.
BROADCAST = 16 << 20


def _decided(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """(q, a): the distinct questions whose answers differ from those without a lexicon, made from the words of table."""
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = wanted.select("q").distinct().repartition(n, "q")
    made = _rounds(own, ["q"], _by_words, T.StringType(), _WORD, _ZIPF, lambda words: words.join(table, ["cyr", "word"]))
    told = made.where("result is not null").withColumnRenamed("result", "a")
    size = told.agg(F.sum(F.length("q") + F.length("a") + 32)).first()[0] or 0
    return F.broadcast(told) if size < BROADCAST else told


def with_lexicon(rows: DataFrame, keys: list[str], work: Callable, result: T.DataType, languages: Languages, plain: Callable | None = None) -> DataFrame:
    """(keys, result): work(row, reader) of every row, where reader knows all words of the lexicon. keys are unique, not null.
    Without a lexicon plain may give the results of rows that need no reader (_alone)."""
    from pyspark.sql.pandas.types import to_arrow_type

    conf = rows.sparkSession.conf
    now = str(conf.get(_ARROW, "64m")).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        conf.set(_ARROW, str(ARROW_BYTES))
    if languages.table is None:  # nobody answers: all words are unknown
        own = T.StructType([*(rows.schema[k] for k in keys), T.StructField("result", result)])
        return rows.mapInArrow(_alone(work, rows.columns, keys, to_arrow_type(result), plain), own)
    lang = F.col("lang")
    lexicon = languages.table.where(lang.isin(languages.cyr, languages.lat)) if languages.cyr and languages.lat else languages.table.where(lang == (languages.cyr or languages.lat or ""))
    of = [F.when(lang == x, F.lit(c)) for x, c in ((languages.cyr, True), (languages.lat, False)) if x]
    lexicon = lexicon.select(F.explode(F.array_compact(F.array(*of, F.lit(None).cast("boolean")))).alias("cyr"), "word", "zipf")
    once: list[DataFrame] = []  # the lexicon, written when it is first asked

    def lookup(wanted):
        if not once:
            once.append(written(lexicon))
        return wanted.join(_decided(wanted, once[0]), "q")

    return _rounds(rows, keys, _by_decisions(work), result, _DECISION, _ANSWER, lookup)
