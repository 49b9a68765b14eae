"""Routing of questions, session memory and the question's way through the engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import catalog, patterns, search, shape
from . import validate

# The wordings that a route goes by. Plain words are matched whole.
SQL_WORDS = ("how many", "count", "total", "sum", "average", "mean", "median", "list all", "show all", "compare", "table", "columns?", "rows?", "data from", "filter", "sort", "group by", "max", "min")
SQL_SPANS = (("value[sd]?", "in"),)
RAG_WORDS = ("explain", "describe", "summarize", "what does", "what is", "why", "how does", "what are the implications", "tell me about", "meaning of", "interpret", "define", "concept", "methodology", "approach", "process")
VIZ_WORDS = ("chart", "plot", "graph", "visuali[sz]e", "trend", "over time", "breakdown", "distribution", "by (month|quarter|year|region|category|segment|department)", "top [0-9]+")
PRINTED_WORDS = ("(figure|graph|chart|table)\\s+(on|in)\\s+(page|section)", "the (graph|chart|figure) (shows|shown|above|below)")
STRONG_WORDS = ("how many", "count", "total", "sum")
STANDALONE_WORDS = ("what is", "who is", "how many", "show me", "list")
FOLLOWUP_WORDS = ("it", "that", "this", "they", "them", "tell me more", "what about", "and")
MEMORY_TURNS, MEMORY_CHARS = 6, 2000

_B, _E = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def word_pattern(w: str) -> str:
    """A wording between boundaries that Java and RE2 read alike, also beside accented letters."""
    return f"{_B}({w}){_E}"


def _count(text: Column, words) -> Column:
    return reduce(lambda a, w: a + text.rlike(word_pattern(w)).cast("int"), words, F.lit(0))


def _any(text: Column, words) -> Column:
    """Whether one of the wordings occurs: one pattern instead of one each."""
    return text.rlike(word_pattern("|".join(words)))


def signals(text: Column) -> dict[str, Column]:
    """Counts of wordings: sql, rag, viz, and whether a printed figure or a strong word occurs."""
    t = F.lower(text)
    spans = reduce(lambda a, s: a + t.rlike(f"{_B}({s[0]}){_E}.*{_B}({s[1]}){_E}|{_B}({s[0]})[^\\p{{L}}\\p{{N}}_]({s[1]}){_E}").cast("int"), SQL_SPANS, F.lit(0))
    return {
        "sql": _count(t, SQL_WORDS) + spans, "rag": _count(t, RAG_WORDS), "viz": _count(t, VIZ_WORDS),
        "printed": _any(t, PRINTED_WORDS) | t.rlike(f"{_B}figure\\s*[0-9]"), "strong": _any(t, STRONG_WORDS),
    }


def route_by(s: dict[str, Column]) -> Column:
    """'SQL', 'RAG' or NULL if the signals decide nothing."""
    no_rag = s["rag"] == 0
    return (
        F.when((s["sql"] >= 2) & no_rag, "SQL").when((s["rag"] >= 2) & (s["sql"] == 0), "RAG")
        .when((s["sql"] == 1) & no_rag & s["strong"], "SQL").when((s["viz"] > 0) & (s["sql"] >= 1) & no_rag & ~s["printed"], "SQL")
    )


def route_of(text: Column) -> Column:
    """The route of a text, its signals bound once."""
    bound = F.array(F.struct(*[c.alias(k) for k, c in signals(text).items()]))
    return F.get(F.transform(bound, lambda s: route_by({k: s[k] for k in ("sql", "rag", "viz", "printed", "strong")})), F.lit(0))


def with_route(df: DataFrame, text: str) -> DataFrame:
    """Add the signals and the route; each pattern runs once a row."""
    found = df.withColumns(signals(F.col(text)))
    return found.withColumn("route", route_by({k: F.col(k) for k in ("sql", "rag", "viz", "printed", "strong")}))


def is_followup(text: Column) -> Column:
    """Whether a question leans on what was said before."""
    t = F.lower(text)
    standalone = _any(t, STANDALONE_WORDS) | t.rlike(f"{_B}explain{_E}.*(the|a){_E}")
    follow = _any(t, FOLLOWUP_WORDS) | t.rlike("^(how|why|when|where)")
    return ~(standalone & ~follow)


# Memory -------------------------------------------------------------------------

def append_messages(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Session messages (session_id, turn, role, content) after an append, the last 2 * MEMORY_TURNS kept."""
    cut = new.withColumn("content", F.left("content", F.lit(MEMORY_CHARS)))
    return last_messages(memory.unionByName(cut))


def last_messages(memory: DataFrame, turns: int = MEMORY_TURNS) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))
    return memory.withColumn("_r", rank).where(F.col("_r") <= 2 * turns).drop("_r")


def history(memory: DataFrame, session_id) -> DataFrame:
    return memory.where(F.col("session_id") == session_id).orderBy("turn")


def session_exists(memory: DataFrame, session_id) -> bool:
    return not memory.where(F.col("session_id") == session_id).isEmpty()


def clear_session(memory: DataFrame, session_id) -> DataFrame:
    return memory.where(F.col("session_id") != session_id)


def clear_all(memory: DataFrame) -> DataFrame:
    return memory.limit(0)


def expire_sessions(memory: DataFrame, now: Column | None = None, idle_s: int = 7200) -> DataFrame:
    """Messages (with their time ``ts``) of the sessions that spoke within ``idle_s`` seconds; the others are reset whole."""
    oldest = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(secs=F.lit(float(idle_s)))
    alive = memory.groupBy("session_id").agg(F.max("ts").alias("_last")).where(F.col("_last") >= oldest).select("session_id")
    return memory.join(alive, "session_id", "left_semi")


# Orchestration --------------------------------------------------------------------

class Providers:
    """What a model may do; every default works offline and is repeatable."""

    def __init__(self, rewrite: Callable | None = None, route: Callable | None = None, slots: Callable | None = None, sql: Callable | None = None, repair: Callable | None = None, answer: Callable | None = None, embed: Callable | None = None):
        self.rewrite = rewrite or (lambda question, past: question)
        self.route = route or (lambda question, tables: "RAG")
        self.slots = slots or patterns.default_slots
        self.sql = sql
        self.repair = repair
        self.answer = answer or (lambda question, context: context)
        self.embed = embed or search.hashed_embedding


class Engine:
    """Answers questions over the four tables (DataFrames)."""

    def __init__(self, spark: SparkSession, facts: DataFrame, registry: DataFrame, chunks: DataFrame, providers: Providers | None = None):
        self.spark, self.facts, self.registry, self.chunks = spark, facts, registry, chunks
        self.providers = providers or Providers()
        self.memory: dict[str, list[dict]] = {}

    def _ask(self, expression: Callable[[Column], Column], text: str):
        return self.spark.range(1).select(expression(F.lit(text))).first()[0]

    def rewrite(self, question: str, past: list[dict]) -> str:
        if len(past) < 2 or not self._ask(is_followup, question):
            return question
        short = [m | {"content": m["content"][:200]} for m in past[-4:]]
        try:
            new = (self.providers.rewrite(question, short) or "").strip()
        except Exception:
            return question
        return new if 3 <= len(new) <= 3 * max(1, len(question)) else question

    def catalogue(self, question: str, document_ids: list[str] | None = None) -> list[dict]:
        facts = self.facts if "fts" in self.facts.columns else catalog.with_fts(self.facts)
        found = [r.asDict(True) for r in catalog.candidates(self.registry, facts, catalog.query_lexemes(question), document_ids).collect()]
        ids = [t["table_id"] for t in found]
        labels = {r.table_id: r.sample_labels for r in catalog.sample_labels(self.facts.where(F.col("table_id").isin(ids))).collect()} if ids else {}
        return [t | {"sample_labels": labels.get(t["table_id"], [])} for t in found]

    def route(self, question: str, tables: list[dict]) -> str:
        by_words = self._ask(route_of, question)
        if by_words:
            return by_words
        try:
            got = self.providers.route(question, catalog.render_catalog(tables)[:1000])
        except Exception:
            got = "RAG"
        return got if got in ("SQL", "RAG", "HYBRID") else "RAG"

    def sql_leg(self, question: str, document_ids: list[str] | None = None) -> dict:
        tables = self.catalogue(question, document_ids)
        used, slots, sql = [t["table_id"] for t in tables], None, None
        try:
            if self.providers.sql:
                sql = self.providers.sql(question, tables)
                got = validate.execute(self.spark, sql)
                if not got["success"] and self.providers.repair:
                    sql = self.providers.repair(sql, got["error"], question)
                    got = validate.execute(self.spark, sql)
                if not got["success"]:
                    raise patterns.PatternError(got["error"])
                df = got["frame"]
            else:
                slots = patterns.pin_table(self.providers.slots(question, tables), tables)
                df, used = patterns.render(self.facts, slots), [slots["table_id"]]
        except patterns.PatternError as e:
            return {"answer": f"Query failed: {e}", "route": "SQL", "artifacts": [], "sources": [], "success": False}
        art = shape.build_artifact(df, question, sql, used)
        records = [{k: shape.json_safe(v) for k, v in r.asDict().items()} for r in df.limit(10).collect()]
        text = shape.result_text(df.columns, records, art[0]["provenance"]["row_count"] if art else 0, slots)
        return {"answer": self.providers.answer(question, text), "route": "SQL", "artifacts": art, "sources": [], "success": True}

    def rag_leg(self, question: str, document_ids: list[str] | None = None) -> dict:
        where = None if document_ids is None else F.col("document_id").isin(document_ids)
        vector = self.providers.embed(question)
        hits = [r.asDict() for r in search.search_with_retry(self.chunks, vector, where).collect()] if len(vector) else []
        if not hits:
            return {"answer": "No relevant information was found.", "route": "RAG", "artifacts": [], "sources": [], "success": False}
        answer = self.providers.answer(question, search.build_context(hits))
        keep = ("score", "heading_context", "source_file", "chunk_id", "section", "start_offset", "end_offset", "page_number")
        sources = [{k: h.get(k) for k in keep} | {"content": h["content"][:200] + "..." if len(h["content"]) > 200 else h["content"]} for h in hits]
        return {"answer": answer, "route": "RAG", "artifacts": [], "sources": sources, "success": True}

    def ask(self, question: str, session_id: str | None = None, document_ids: list[str] | None = None, force_route: str | None = None) -> dict:
        past = self.memory.setdefault(session_id, []) if session_id else []
        full = self.rewrite(question, past)
        route = force_route or self.route(full, self.catalogue(full, document_ids))
        if route == "HYBRID":
            legs = [self.sql_leg(full, document_ids), self.rag_leg(full, document_ids)]
            out = {"answer": "\n\n".join(x["answer"] for x in legs if x["success"]) or legs[0]["answer"], "route": route, "artifacts": legs[0]["artifacts"], "sources": legs[1]["sources"], "success": any(x["success"] for x in legs)}
            for a in out["artifacts"]:
                a["provenance"]["answer_is_llm_merged"] = True
        else:
            out = (self.sql_leg if route == "SQL" else self.rag_leg)(full, document_ids)
        if session_id:
            past += [{"role": r, "content": c[:MEMORY_CHARS]} for r, c in (("user", question), ("assistant", out["answer"]))]
            del past[: -2 * MEMORY_TURNS]
        return {"artifacts": []} | out | {"query": full}
