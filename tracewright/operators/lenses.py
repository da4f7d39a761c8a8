"""Review lenses of a run (H4-H6, H8): which calls dispatch a lens, which records they join, and how dispatches and responses pair.

A run's calls, responses and commitment lines become one stream of events, dealt by run and sorted by turn
and place. A task walks it once and carries the open run only: its attempts and what of the present turn
still waits for its place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewright.functions.tables import gathered, written

# The lenses a router or a subagent can run, in their order, and the router's name.
ROUTED_LENSES = ["contract", "quality", "security"]
ROUTER = r"codex-lens\.sh"
# The grammar of a shell call's key argument: its wrapper, a plain word, assignments before a program, the router's words.
WRAPPER = r"^(?:bash|sh|zsh)\s+-[a-z]*c[a-z]*\s+"
PLAIN = r"[^\s;&|>…]"
ASSIGNED = rf"(?:\w+={PLAIN}*[ \t]+)*"
ONE_CALL = rf"^{ASSIGNED}{PLAIN}*{ROUTER}(?:[ \t]+(?:2>[ \t]*)?{PLAIN}+)*"
REDIRECTED = rf"{ONE_CALL}[ \t]+>[ \t]*({PLAIN}+)(?:[ \t]+2>[ \t]*{PLAIN}+)?$"
CUT_CALL = rf"(?:^|[\n;&|][ \t]*){ASSIGNED}{PLAIN}*{ROUTER}\b[^\n;&|…]*…$"
# Tool kinds.
SUBAGENT, SHELLS = "task", ["bash", "custom"]
SLACK_SECONDS = 5


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def command(key: Column) -> Column:
    """The command of a shell call's key argument, without the shell that wraps it."""
    return F.regexp_replace(trimmed(F.coalesce(key, F.lit(""))), WRAPPER, "")


def unquoted(path: Column) -> Column:
    return F.regexp_replace(path, "^[\"']+|[\"']+$", "")


def dispatched_lens(kind: Column, key: Column) -> Column:
    """H4: the lens that a call dispatches: a subagent's whose description names a lens or a review, or a router call's by its flag; else null."""
    low = F.lower(F.coalesce(key, F.lit("")))
    named = F.lit(None).cast("string")
    for name in reversed(ROUTED_LENSES):
        named = F.when(low.contains(name), name).otherwise(named)
    flag = F.regexp_extract(low, r"--lens\s+(\w+)", 1)
    routed = F.when(low.rlike(rf"{ROUTER}\b[^\n]*--lens\b") & flag.isin(ROUTED_LENSES), flag)
    return F.when(kind == SUBAGENT, F.when(low.contains("lens") | low.contains("review"), named)).otherwise(routed)


def cut_router(kind: Column, key: Column) -> Column:
    """H4: a router call that was cut before the name of its lens."""
    low = F.regexp_replace(command(F.lower(key)), r"--lens\s+\w*…$", "…")
    return F.coalesce((kind != SUBAGENT) & ~low.rlike(r"--lens\s+\w") & low.rlike(CUT_CALL), F.lit(False))


def router_alone(key: Column) -> Column:
    """H4: the command is the router and nothing else, so its result is the router's."""
    return command(key).rlike(ONE_CALL + "$")


def redirect_of(key: Column) -> Column:
    """H4: the path that the router alone sends its output to, or null; appending is not one."""
    return F.nullif(unquoted(F.regexp_extract(command(key), REDIRECTED, 1)), F.lit(""))


def read_path(kind: Column, key: Column) -> Column:
    """H4: the one path that a shell call prints and does nothing else, or null."""
    words = F.filter(F.split(command(key), r"\s+"), lambda w: w != "")
    rest = F.slice(words, 2, 1 << 20)
    rest = F.when(F.get(rest, F.lit(0)) == "--", F.slice(rest, 2, 1 << 20)).otherwise(rest)
    program = F.get(words, F.lit(0))
    return F.when(kind.isin(SHELLS) & ((program == "cat") | program.endswith("/cat")) & (F.size(rest) == 1), unquoted(F.get(rest, F.lit(0))))


def lens_calls(calls: DataFrame) -> DataFrame:
    """H4: calls (kind, key_arg and others) with lens, cut, alone, redirect and reads."""
    kind, key = F.col("kind"), F.col("key_arg")
    return calls.select("*", dispatched_lens(kind, key).alias("lens"), cut_router(kind, key).alias("cut"), router_alone(key).alias("alone"), redirect_of(key).alias("redirect"), read_path(kind, key).alias("reads"))


def walked(batches: Iterator[pa.RecordBatch], schema: pa.Schema, state) -> Iterator[pa.RecordBatch]:
    """Rows of a stream sorted by run, handed to a new ``state()`` a run; what ``end`` gives of each run is put out in batches."""
    run, one, rows = None, None, []
    for b in batches:
        for r in b.to_pylist():
            if one is None or r["run_id"] != run:
                if one is not None:
                    rows += one.end()
                run, one = r["run_id"], state(r["run_id"])
            one.take(r)
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if one is not None:
        rows += one.end()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def fold_runs(events: DataFrame, order: list[str], result: str, state) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(result))
    sorted_ = gathered(events, "run_id").sortWithinPartitions("run_id", *order)
    return sorted_.mapInArrow(lambda b: walked(b, schema, state), result)


class Joins:
    """A run's records, held while its calls pass in order; each record serves one call, the one it names or the first in whose time it began."""

    def __init__(self, run: str):
        self.run, self.by_id, self.free, self.out = run, {}, [], []

    def take(self, r: dict) -> None:
        if r["is_record"]:
            if r["dispatch_id"]:
                self.by_id.setdefault(r["dispatch_id"], deque()).append(r)
            elif r["lens"] and r["started_at"] is not None:
                self.free.append(r)
            return
        if not r["call_id"]:
            return
        named = self.by_id.get(r["call_id"])
        if named:
            self.join(r, named.popleft(), "dispatch")
        elif r["router"] and r["started_at"] is not None and (r["lens"] or r["cut"]):
            # records are in order of their start
            for k, x in enumerate(self.free):
                late = r["latest"] is not None and x["started_at"] > r["latest"]
                if x["started_at"] >= r["earliest"] and not late and (not r["lens"] or x["lens"] == r["lens"]):
                    self.join(r, self.free.pop(k), "time")
                    break

    def join(self, call: dict, record: dict, basis: str) -> None:
        self.out.append({"run_id": self.run, "call_id": call["call_id"], "record_id": record["record_id"], "basis": basis})

    def end(self) -> list[dict]:
        return self.out


def join_records(calls: DataFrame, records: DataFrame, slack: int = SLACK_SECONDS) -> DataFrame:
    """H5: (run_id, call_id, record_id, basis). A call takes the record that names it; a router call else the earliest of its lens that names none
    and began in the call's time, ``slack`` seconds wider, without an end where no duration is known. A cut router call takes one of any lens.

    calls: run_id, turn_idx, seq, call_id, kind, lens, cut, started_at, duration_ms; records: run_id, record_id, dispatch_id, r_lens,
    r_started. A run's records that name no call are held by its task.
    """
    wide = F.make_interval(secs=F.lit(slack))
    none = lambda kind: F.lit(None).cast(kind)
    rows = calls.select("run_id", F.lit(False).alias("is_record"), "turn_idx", "seq", "call_id", none("string").alias("dispatch_id"), none("string").alias("record_id"), "lens", "cut", (F.col("kind") != SUBAGENT).alias("router"), "started_at", (F.col("started_at") - wide).alias("earliest"), F.when(F.col("duration_ms") > 0, F.col("started_at") + F.make_interval(secs=F.col("duration_ms") / 1000) + wide).alias("latest"))
    held = records.select("run_id", F.lit(True).alias("is_record"), F.lit(-1).cast("long").alias("turn_idx"), F.lit(0).cast("long").alias("seq"), none("string").alias("call_id"), "dispatch_id", "record_id", F.col("r_lens").alias("lens"), F.lit(False).alias("cut"), F.lit(False).alias("router"), F.col("r_started").alias("started_at"), none("timestamp").alias("earliest"), none("timestamp").alias("latest"))
    both = held.unionByName(rows.withColumns({"turn_idx": F.col("turn_idx").cast("long"), "seq": F.col("seq").cast("long")})).withColumn("first", F.when(F.col("is_record"), F.col("started_at")))
    return fold_runs(both, ["turn_idx", "seq", "first", "record_id"], "run_id string, call_id string, record_id string, basis string", Joins)


ATTEMPT = (
    "run_id string, place int, lens string, round int, attempt int, status string, dispatched boolean, routed boolean, provenance string, dispatch_id string, dispatch_turn_idx long, execution_id string, response_id string, "
    "response_turn_idx long, verdict string, summary string, context_kind string, context_state string, contaminated boolean, superseded boolean, late boolean, malformed string, source_path string, source_line long"
)
#: What an attempt takes from the response that answers it.
ANSWER = ["verdict", "summary", "context_kind", "context_state", "contaminated"]


class Attempts:
    """The attempts of a run while its events pass; ``take`` gets them by turn: what the turn knows at its start, its calls with their results, its text."""

    def __init__(self, run: str):
        self.run, self.round = run, 0
        self.all: list[dict] = []
        self.newest: dict[tuple[str, int], dict] = {}
        self.of_dispatch: dict[str, dict] = {}
        self.of_path: dict[str, list[dict]] = {}
        self.promised: dict[tuple[int, str], None] = {}
        self.turn, self.lines, self.moved = None, deque(), False
        self.waiting: list[dict] = []
        self.files: deque[dict] = deque()
        self.inlined: deque[dict] = deque()
        self.now: dict | None = None

    # events

    def take(self, r: dict) -> None:
        if r["turn_idx"] != self.turn:
            self.finish()
            self.turn = r["turn_idx"]
        getattr(self, r["event"])(r)

    def line_ahead(self, r: dict) -> None:
        self.lines.append(r)

    def notification(self, r: dict) -> None:
        if r["after_end"]:
            a = self.of_dispatch.get(r["dispatch_id"])
            if a is not None and not a["response_id"]:
                self.answer(a, r)
                a["late"] = True
        elif r["dispatch_id"] and r["dispatch_id"] not in self.of_dispatch:
            self.waiting.append(r)
        else:
            self.respond(r)

    def file_write(self, r: dict) -> None:
        self.files.append(r)

    def assistant(self, r: dict) -> None:
        self.inlined.append(r)

    def call(self, r: dict) -> None:
        if r["at"] is not None:
            while self.files and self.files[0]["at"] is not None and self.files[0]["at"] <= r["at"]:
                self.write(self.files.popleft())
            ready = [x for x in self.waiting if x["at"] is not None and x["at"] <= r["at"] and x["dispatch_id"] in self.of_dispatch]
            self.waiting = [x for x in self.waiting if not any(x is y for y in ready)]
            for x in ready:
                self.respond(x)
        self.now = r
        if r["lens"]:
            self.dispatch(r)

    def result(self, r: dict) -> None:
        """A response in the result of the call before it."""
        c = self.now
        if c["lens"]:
            if not c["routed"] or c["alone"]:
                a = self.respond(r)
                if a is not None and c["routed"]:
                    a["provenance"] = "router_result"
        elif c["reads"]:
            open_ = [a for a in self.of_path.get(c["reads"], ()) if a["lens"] == r["lens"] and a["status"] == "dispatched"]
            if open_:
                self.answer(open_[-1], r)
                open_[-1]["provenance"] = "read_back"

    def line(self, r: dict) -> None:
        self.calls_end()
        self.commit(r)

    def block(self, r: dict) -> None:
        self.calls_end()
        if self.inlined:
            self.respond(self.inlined.popleft())

    # what they do

    def calls_end(self) -> None:
        """Responses that found no place among the turn's calls."""
        while self.files:
            self.write(self.files.popleft())
        waiting, self.waiting = self.waiting, []
        for x in waiting:
            self.respond(x)

    def finish(self) -> None:
        self.calls_end()
        while self.inlined:
            self.respond(self.inlined.popleft())
        self.lines, self.moved, self.now = deque(), False, None

    def commit(self, r: dict) -> None:
        self.round = r["round"]
        for name in r["names"] or ():
            self.promised[r["round"], name] = None

    def move(self, lens: str) -> None:
        """Before a call or file of a lens: the turn's first line counts, each later one when the lens has answered in the round."""
        last = self.newest.get((lens, self.round))
        if self.lines and (not self.moved or last is not None and last["status"] == "parsed"):
            self.commit(self.lines.popleft())
            self.moved = True

    def begin(self, lens: str, round_: int, turn: int, dispatch_id: str | None, number: int | None = None, **more) -> dict:
        last = self.newest.get((lens, round_))
        a = dict.fromkeys(["status", "provenance", "execution_id", "response_id", "malformed", "source_path", "source_line", *ANSWER])
        a |= {"run_id": self.run, "lens": lens, "round": round_, "attempt": number or (last["attempt"] + 1 if last else 1), "dispatched": turn >= 0, "routed": False, "dispatch_id": dispatch_id, "dispatch_turn_idx": turn, "response_turn_idx": -1, "late": False, "contaminated": False} | more
        self.all.append(a)
        if last is None or a["attempt"] >= last["attempt"]:
            self.newest[lens, round_] = a
        if dispatch_id:
            self.of_dispatch[dispatch_id] = a
        return a

    def dispatch(self, r: dict) -> None:
        self.move(r["lens"])
        a = self.begin(r["lens"], r["round"] or self.round, self.turn, r["dispatch_id"], r["attempt"], status="failed" if r["failed"] else "dispatched", execution_id=r["execution_id"], routed=r["routed"])
        if r["routed"] and r["redirect"]:
            self.of_path.setdefault(r["redirect"], []).append(a)

    def write(self, r: dict) -> None:
        self.move(r["lens"])
        self.respond(r)

    def respond(self, r: dict) -> dict | None:
        a = self.of_dispatch.get(r["dispatch_id"]) if r["dispatch_id"] else None
        if a is not None:
            if a["response_id"]:
                if self.other_lens(a, r):
                    return None
                a = self.begin(a["lens"], a["round"], a["dispatch_turn_idx"], a["dispatch_id"], status="dispatched", routed=a["routed"])
        elif r["event"] == "notification" or r["lens"] not in ROUTED_LENSES:
            return None
        else:
            a = self.newest.get((r["lens"], self.round))
            if a is None or a["status"] != "dispatched":
                a = self.begin(r["lens"], self.round, -1, None)
        self.answer(a, r)
        return a

    def other_lens(self, a: dict, r: dict) -> bool:
        return r["lens"] in ROUTED_LENSES and r["lens"] != a["lens"]

    def answer(self, a: dict, r: dict) -> None:
        a |= {"response_id": r["response_id"], "response_turn_idx": r["turn_idx"], "source_path": r["source_path"], "source_line": r["source_line"]}
        a["late"] |= a["round"] < self.round
        if self.other_lens(a, r):
            a |= {"status": "responded", "malformed": f"lens mismatch: response names {r['lens']}, dispatch named {a['lens']}"}
        else:
            a |= {c: r[c] for c in ANSWER} | {"malformed": r["reason"], "status": "parsed" if r["status"] == "parsed" else "responded"}

    def end(self) -> list[dict]:
        self.finish()
        for round_, name in self.promised:
            if (name, round_) not in self.newest:
                self.begin(name, round_, -1, None, status="missing")["attempt"] = 0
        rank = {name: k for k, name in enumerate(ROUTED_LENSES)}
        rows = sorted(self.all, key=lambda a: (a["round"], rank.get(a["lens"], len(rank)), a["lens"], a["attempt"]))
        return [a | {"place": k, "superseded": self.newest[a["lens"], a["round"]] is not a} for k, a in enumerate(rows)]


def text_items(texts: DataFrame) -> DataFrame:
    """The commitment lines with a round and the lens blocks of assistant texts, in text order: run_id, turn_idx, ord, event, round, names."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)dispatching \([^)\n]*\)\s*:[^\n]*|```json[\s\S]*?(?:```|\z)"), 0)
    items = texts.select("run_id", "turn_idx", F.posexplode(found).alias("ord", "item"))
    head, tail = F.regexp_extract("item", r"\(([^)\n]*)\)", 1), F.lower(F.regexp_extract("item", r"\)\s*:([^\n]*)", 1))
    block = F.col("item").startswith("```")
    round_ = F.try_to_number(F.nullif(F.regexp_extract(head, r"(?i)round (\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")
    rows = items.select("run_id", "turn_idx", F.col("ord").cast("long").alias("ord"), F.when(block, "block").otherwise("line").alias("event"), F.when(~block, round_).alias("round"), F.when(~block, F.filter(F.array(*map(F.lit, ROUTED_LENSES)), lambda n: tail.contains(n))).alias("names"), "item")
    return rows.where((block & F.col("item").contains('"lens"')) | F.col("round").isNotNull()).drop("item")


EVENT = (
    "run_id string, turn_idx long, phase int, ord long, sub long, event string, lens string, round int, attempt int, names array<string>, at timestamp, dispatch_id string, routed boolean, alone boolean, redirect string, reads string, failed boolean, "
    "execution_id string, response_id string, status string, reason string, verdict string, summary string, context_kind string, context_state string, contaminated boolean, source_path string, source_line long, after_end boolean"
)


def _as_events(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select(*((columns[f.name] if isinstance(columns.get(f.name), Column) else F.col(columns.get(f.name, f.name)) if columns.get(f.name, f.name) in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EVENT)))


def lens_events(runs: DataFrame, texts: DataFrame, calls: DataFrame, responses: DataFrame, records: DataFrame, joins: DataFrame) -> DataFrame:
    """The events of runs, in the order of ``phase``, ``ord`` and ``sub`` of a turn.

    runs: run_id, first_idx, last_idx, inlines (whether the runtime inlines its passes); texts: run_id, turn_idx, text; calls: of lens_calls;
    responses: run_id, turn_idx, ord, origin, call_id or dispatch_id, at, response columns; records: run_id, record_id, r_lens, r_round, r_attempt.
    """
    joined = joins.select("run_id", "call_id", "record_id").join(records.select("run_id", "record_id", "r_lens", "r_round", "r_attempt"), ["run_id", "record_id"])
    span = runs.select("run_id", "first_idx", "last_idx", "inlines")
    inside = (F.col("turn_idx") >= F.col("first_idx")) & (F.col("turn_idx") <= F.col("last_idx"))
    lens = F.coalesce(F.nullif("r_lens", F.lit("")), "lens")
    # both are met several times, and calls come from a walk of their own
    calls = written(calls.join(span, "run_id").where(inside).join(joined, ["run_id", "call_id"], "left").withColumn("lens", lens).where(F.coalesce("lens", "reads", F.col("started_at").cast("string")).isNotNull()), "lens-calls")
    items = written(text_items(texts.join(span, "run_id").where(inside)), "lens-items")
    ahead = _as_events(items.where("event = 'line'"), phase=F.lit(0), event=F.lit("line_ahead"), sub=F.lit(0))
    # a turn without a line takes its rounds from the records that its calls joined
    silent = calls.where("r_round > 0").join(items.where("event = 'line'").select("run_id", "turn_idx").distinct(), ["run_id", "turn_idx"], "left_anti")
    told = _as_events(silent.select("run_id", "turn_idx", "seq", "r_round"), phase=F.lit(0), ord="seq", sub=F.lit(0), event=F.lit("line_ahead"), round="r_round")
    is_call = _as_events(calls, phase=F.lit(2), ord="seq", sub=F.lit(-1), event=F.lit("call"), round=F.when(F.col("r_round") > 0, F.col("r_round")), attempt=F.when(F.col("r_attempt") > 0, F.col("r_attempt")), at="started_at", dispatch_id="call_id", routed=F.col("kind") != SUBAGENT, execution_id="record_id")
    rows = responses.join(span, "run_id").where(F.col("turn_idx") >= F.col("first_idx")).withColumn("after_end", F.col("turn_idx") > F.col("last_idx"))
    own = F.col("origin").isin("file_write", "assistant") & F.col("inlines")
    placed = _as_events(rows.where((F.col("origin") == "notification") | (own & ~F.col("after_end"))), phase=F.lit(1), sub=F.lit(0), event="origin")
    results = rows.where((F.col("origin") == "result") & ~F.col("after_end")).join(calls.select("run_id", F.col("turn_idx").alias("call_turn"), "call_id", "seq").where("call_id is not null"), ["run_id", "call_id"]).where("turn_idx = call_turn")
    result = _as_events(results.withColumn("dispatch_id", F.col("call_id")), phase=F.lit(2), ord="seq", sub="ord", event=F.lit("result"))
    spoken = _as_events(items, phase=F.lit(3), sub=F.lit(0))
    every = ahead
    for part in (told, is_call, placed, result, spoken):
        every = every.union(part)
    return every


def attempt_walk(events: DataFrame) -> DataFrame:
    """H6: the attempts of each run (columns of ATTEMPT), in order of round, lens and number (``place``)."""
    return fold_runs(events, ["turn_idx", "phase", "ord", "sub", "response_id"], ATTEMPT, Attempts)


def child_verdicts(attempts: DataFrame, records: DataFrame, runs: DataFrame, responses: DataFrame) -> DataFrame:
    """H8: attempts, where a routed one without a response takes the last assistant response of its record's own session.

    records: run_id, record_id, agent, session_id; runs: run_id, run_agent, run_session; responses: agent, session_id, turn_idx, ord, origin, response columns.
    """
    child = records.join(runs, "run_id").where((F.col("agent") != "") & (F.col("session_id") != "") & ~((F.col("agent") == F.col("run_agent")) & (F.col("session_id") == F.col("run_session"))))
    fields = ["response_id", "turn_idx", "lens", "status", "reason", "source_path", "source_line", *ANSWER]
    last = responses.where("origin = 'assistant'").groupBy("agent", "session_id").agg(F.max_by(F.struct(*fields), F.struct("turn_idx", "ord")).alias("last"))
    found = child.join(last, ["agent", "session_id"]).select("run_id", F.col("record_id").alias("execution_id"), "last")
    both = attempts.join(found, ["run_id", "execution_id"], "left")
    take = F.col("routed") & F.col("response_id").isNull() & F.col("last").isNotNull()
    other = F.col("last.lens").isin(ROUTED_LENSES) & (F.col("last.lens") != F.col("lens"))
    put = {c: F.when(take & ~F.coalesce(other, F.lit(False)), F.col(f"last.{c}")).otherwise(F.col(c)) for c in ANSWER}
    put |= {"response_id": F.when(take, F.col("last.response_id")).otherwise(F.col("response_id")), "response_turn_idx": F.when(take, F.col("last.turn_idx")).otherwise(F.col("response_turn_idx"))}
    put |= {c: F.when(take, F.col(f"last.{c}")).otherwise(F.col(c)) for c in ("source_path", "source_line")}
    put["provenance"] = F.when(take, "child_session").otherwise(F.col("provenance"))
    put["malformed"] = F.when(take, F.when(other, F.concat(F.lit("lens mismatch: response names "), F.col("last.lens"), F.lit(", dispatch named "), F.col("lens"))).otherwise(F.col("last.reason"))).otherwise(F.col("malformed"))
    put["status"] = F.when(take, F.when(~F.coalesce(other, F.lit(False)) & (F.col("last.status") == "parsed"), "parsed").otherwise("responded")).otherwise(F.col("status"))
    return both.select(*(put[c].alias(c) if c in put else F.col(c) for c in attempts.columns))
