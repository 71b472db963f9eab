"""Context packing, prompts and answer routing, as columns over one row per question.

A question's hits are an array of at most ``top_k`` structs, so packing needs no
shuffle beyond the one that gathers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.settings import NO_CONTEXT_A, NO_ROOM, NOT_FOUND, PROMPT_A_HEAD, Policy, SettingsB


def gather(hits: DataFrame, k: int, rank: str = "rank", fields: tuple[str, ...] = ("score", "doc_path", "chunk_id", "chunk_text")) -> DataFrame:
    """``query_id, hits``: the first ``k`` hits in order of rank."""
    kept = hits.filter(F.col(rank) <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), *fields))).alias("hits"))
    return kept


def context_a(hits: Column, limit: int = 8) -> Column:
    """The pieces of context of engine A; one fixed sentence without hits."""
    lines = F.transform(F.slice(hits, 1, limit), lambda h: F.concat(F.lit("source_path: "), h["source_path"], F.lit("\n"), h["chunk_text"]))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) == 0, F.array(F.lit(NO_CONTEXT_A))).otherwise(lines)


def prompt_a(question: Column, context: Column) -> Column:
    return F.concat(F.lit(PROMPT_A_HEAD + "Context:\n"), F.array_join(context, "\n\n---\n\n"), F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:"))


def shown(hits: Column, chars: Column | int, policy: Policy) -> Column:
    """Tagged and cut texts of the first sources, joined by an empty line."""
    size = F.lit(chars) if isinstance(chars, int) else chars

    def line(h: Column) -> Column:
        text = F.substring(h["chunk_text"], F.lit(1), size)
        return F.concat(T.source_tag(h["doc_path"], h["chunk_id"], h["score"]), F.lit("\n"), text) if policy.show_sources else text

    return F.array_join(F.transform(F.slice(hits, 1, policy.max_sources), line), "\n\n")


def snippet(hits: Column, policy: Policy | None = None, chars: int = 800) -> Column:
    return shown(hits, chars, policy or Policy())


def messages(question: Column, context: Column, system: str) -> Column:
    """System and user message, as an array of ``role, content``."""
    user = F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def prompt_text(chat: Column) -> Column:
    """The text whose tokens are counted."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), m["content"], F.lit("\n"))), "\n")


def _limits(first: int, last: int, share: float) -> list[int]:
    out = []
    while first > last:
        first = max(last, int(first * share))
        out.append(first)
    return out


def fit_states(hits: Column, first: int = 600, min_hits: int = 1) -> Column:
    """What the fitting tries, in order: shorter chunks down to 200, fewer hits, shorter chunks down to 80."""
    n = F.size(hits)
    few = F.least(n, F.lit(min_hits))
    state = lambda limit, k: F.struct(F.lit(limit).alias("chars"), k.cast("int").alias("n_hits"))
    short = F.array(*[state(x, n) for x in (first, *_limits(first, 200, 0.8))])
    fewer = F.when(n > min_hits, F.transform(F.sequence(n - 1, F.lit(min_hits), F.lit(-1)), lambda k: state(200, k))).otherwise(F.array().cast("array<struct<chars:int,n_hits:int>>"))
    shortest = F.array(*[state(x, few) for x in _limits(200, 80, 0.7)])
    return F.concat(short, fewer, shortest)


def fit_limits(first: int = 600) -> list[int]:
    """The lengths to which the fitting cuts chunks, each once."""
    return list(dict.fromkeys([first, *_limits(first, 200, 0.8), 200, *_limits(200, 80, 0.7)]))


def first_fitting(df: DataFrame, states: Column) -> DataFrame:
    """Adds ``fit``: the first of the weighed ``states`` that fits, else the last."""
    tried = df.withColumn("_tried", states)
    fitting = F.filter("_tried", lambda t: t["fits"])
    return tried.withColumn("fit", F.when(F.size(fitting) > 0, F.element_at(fitting, 1)).otherwise(F.element_at("_tried", -1))).drop("_tried")


def fit_context(df: DataFrame, settings: SettingsB | None = None) -> DataFrame:
    """Adds ``fit`` (chars, n_hits, tokens, state, fits): the first state whose prompt fits, else the last.

    ``df`` has ``question`` and ``hits``.  All states of a question are weighed in its own
    row; there is no loop over the data.
    """
    s = settings or SettingsB()
    states = fit_states(F.col("hits"))

    def weigh(state: Column, i: Column) -> Column:
        context = shown(F.slice(F.col("hits"), F.lit(1), state["n_hits"]), state["chars"], Policy(s.policy.vector_min_score, s.policy.keyword_min_score, s.policy.allow_general_fallback, True, s.policy.max_sources))
        tokens = T.token_count(prompt_text(messages(F.col("question"), context, s.system_prompt)))
        return F.struct(state["chars"].alias("chars"), state["n_hits"].alias("n_hits"), tokens.alias("tokens"), i.alias("state"), (tokens + max(1, s.max_tokens) <= s.n_ctx).alias("fits"))

    return first_fitting(df, F.transform(states, weigh))


def use_context(best_vector: Column, best_keyword: Column, policy: Policy | None = None) -> Column:
    """Is some best score high enough?  Null stands for no hit."""
    p = policy or Policy()
    return F.coalesce(best_vector >= p.vector_min_score, F.lit(False)) | F.coalesce(best_keyword >= p.keyword_min_score, F.lit(False))


def route(question: Column, with_context: Column, policy: Policy | None = None) -> Column:
    """``empty``, ``general``, ``not_found``, ``snippet`` or ``context``."""
    p = policy or Policy()
    bare = T.strip(F.coalesce(question, F.lit("")))
    none = F.lit("general" if p.allow_general_fallback else "not_found")
    return F.when(bare == "", "empty").when(~with_context, none).when(F.size(T.query_tokens_b(bare)) == 1, "snippet").otherwise("context")


def answer(df: DataFrame, settings: SettingsB | None = None, keep_fitted_limit: bool = True, tokenizer: Callable | None = None) -> DataFrame:
    """Adds ``route, messages, reply`` to rows of question, hits (merged), kw_hits, best_vector, best_keyword.

    ``tokenizer`` makes an ``operators.tokens.Tokenizer`` for the counts; without it tokens are words.
    ``reply`` is the final text where no model is needed; ``messages`` what a model would get.
    The studied code forgets the fitted chunk length; ``keep_fitted_limit=False`` does too.
    """
    s = settings or SettingsB()
    p = s.policy
    from corpusmill.operators import tokens

    fitted = (fit_context(df, s) if tokenizer is None else tokens.fit_counted(df, tokenizer, s)).withColumn("route", route(F.col("question"), use_context(F.col("best_vector"), F.col("best_keyword"), p), p))
    context = shown(F.slice("hits", F.lit(1), F.col("fit.n_hits")), F.col("fit.chars") if keep_fitted_limit else 600, p)
    chat = messages(F.col("question"), context, s.system_prompt)
    if tokenizer is None:
        size = T.token_count(prompt_text(chat))
    else:
        fitted = tokens.count_tokens(fitted.withColumn("_prompt", prompt_text(chat)), tokenizer, "_prompt", "_size").drop("_prompt")
        size = F.col("_size")
    over = size + s.max_tokens > s.n_ctx
    general = F.array(F.struct(F.lit("system").alias("role"), F.lit(s.general_prompt).alias("content")), F.struct(F.lit("user").alias("role"), T.strip(F.col("question")).alias("content")))
    fitted = fitted.withColumn("route", F.when((F.col("route") == "context") & over, "general" if p.allow_general_fallback else "no_room").otherwise(F.col("route"))).drop("_size")
    sources = F.when(F.size("kw_hits") > 0, F.col("kw_hits")).otherwise(F.col("hits"))
    reply = F.when(F.col("route") == "empty", "").when(F.col("route") == "not_found", NOT_FOUND).when(F.col("route") == "no_room", NO_ROOM).when(F.col("route") == "snippet", snippet(sources, p))
    return fitted.withColumn("messages", F.when(F.col("route") == "context", chat).when(F.col("route") == "general", general)).withColumn("reply", reply)
