"""Transcripts, questions and answers, prompts and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import rx
from telar.operators.retrieval import NO_STYLE, normalize

HISTORY = 8
STYLE_EXAMPLES, STYLE_CHARS = 2, 220
FOLLOW_UP_CHARS, LONG_REQUEST = 20, 24

# What shows that a prompt goes on, asks for facts, greets, or remarks.
FOLLOW_UP = ("more", "and that", "and stuff", "please", "explain better", "expand", "continue", "go on", "come on", "go ahead", "and then")
FACTUAL = (
    "what does", "what is", "who is", "where", "when", "origin", "toponym", "definition", "etymology", "history", "culture", "guanche", "aboriginal",
    "forests", "tabaibas", "flora", "fauna", "academia canaria", "canariwiki", "gevic", "heritage", "consultation",
)
ASKING = ("what", "who", "where", "when")
REQUESTS = ("tell me", "explain", "talk to me", "say", "describe")
GREETINGS = ("hello", "hi", "hey", "good morning", "good evening")
OPENINGS = ("hello ", "hi ", "hey ")
QUESTIONS = ("what does", "what is", "who is")
REMARKS = ("bro", "dude", "that's it", "long live canary islands", "nice", "great")
# The prompts, word for word.
SYSTEM_PROMPT = (
    "You are a virtual assistant from the Canary Islands. You reply using the vocabulary, syntax, and natural phrasing of Canary Islands Spanish. "
    "When retrieved knowledge-base context is available, use it as the primary factual source without inventing details that contradict it. "
    "Retrieved context only provides facts and references; do not copy its tone if it feels encyclopedic or neutral. "
    "Always keep the output natural, clear, and recognizably Canarian. Reply only to the concrete intent of the user's latest message. "
    "Do not recycle training examples or inject food, music, or customs unless the user asks for them. "
    "If the user greets you, return a short greeting. If the user makes a casual remark, answer briefly and stay close to that remark."
)
SYSTEM_SUFFIX = " When retrieved context is available, use it for facts without losing the Canary style."
AUGMENT_INSTRUCTIONS = (
    "Instructions:\n- Reply with natural, close, Canary-style wording.\n"
    "- Use the retrieved context only for facts, definitions, places, names, or documentary nuances.\n"
    "- Do not copy an encyclopedic tone even if the context has one.\n"
    "- If the context is not useful, still answer naturally and do not invent specific facts.\n"
    "- Stay tightly aligned with the user's intent."
)
CHAT_INSTRUCTIONS = (
    "Instructions:\n- Answer only what was just asked, without changing the topic.\n- If the user greets you or sends a short message, answer briefly.\n"
    "- If the user makes a casual remark, respond to that remark and do not turn the answer into a cultural fact sheet.\n"
    "- Use the retrieved context only for facts, names, definitions, places, or documentary nuances.\n- Do not copy the encyclopedic tone of the context.\n"
    "- Always keep a natural Canary-flavored answer.\n- If the context is insufficient, say so naturally and do not invent specific facts.\n"
    "- If the question does not need external knowledge, answer in your normal style and move on."
)


def _any(col: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(col, F.lit(m))
    return out


def _begins(col: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col, F.lit(p))
    return out


def is_follow_up(prompt: Column) -> Column:
    """Short, or with a word that goes on."""
    p = F.lower(normalize(prompt))
    return (F.length(p) <= FOLLOW_UP_CHARS) | _any(p, FOLLOW_UP)


def needs_retrieval(prompt: Column) -> Column:
    """Whether a prompt asks for facts; blank and null ones do not."""
    p = F.lower(normalize(F.coalesce(prompt, F.lit(""))))
    return (p != "") & (_any(p, FACTUAL) | _begins(p, ASKING) | (_begins(p, REQUESTS) & (F.length(p) > LONG_REQUEST)))


def intent(prompt: Column) -> Column:
    p = F.lower(normalize(F.coalesce(prompt, F.lit(""))))
    return (
        F.when(p == "", "empty").when(p.isin(*GREETINGS) | _begins(p, OPENINGS), "greeting").when(_any(p, QUESTIONS), "factual_question")
        .when(F.contains(p, F.lit("?")), "general_question").when(_any(p, REMARKS), "casual_comment").otherwise("general_comment")
    )


def split_turns(df: DataFrame, key: str = "code", text: str = "transcript") -> DataFrame:
    """``key, pos, speaker, text``: what follows each label at a line's start, without overlaps in brackets; preamble and blank turns dropped.

    One row per key is read; null keys and texts have no turns.
    """
    label = r"(?md)^[A-Z]{1,3}\d*[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}]*:"
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).dropDuplicates([key])
    parts = F.filter(F.split(F.col(text), rf"(?md)(?=^[A-Z]{{1,3}}\d*[{rx.WS}]*:)"), lambda x: x.rlike(label))
    turns = rows.select(F.col(key), F.posexplode(parts).alias("pos", "_x"))
    said = F.regexp_replace(F.regexp_replace("_x", rf"(?s)^[A-Z]{{1,3}}\d*[{rx.WS}]*:", ""), r"\[[A-Z]{1,3}\d*:[^\]]*\]", "")
    return turns.select(key, "pos", F.regexp_extract("_x", r"^([A-Z]{1,3}\d*)", 1).alias("speaker"), rx.squeeze(said).alias("text")).where("text != ''")


def speaker_role(speaker: Column) -> Column:
    return F.when(F.startswith(speaker, F.lit("E")), "interviewer").when(F.startswith(speaker, F.lit("I")), "interviewee")


def qa_pairs(turns: DataFrame, key: str = "code") -> DataFrame:
    """``key, pair_no, question, answer``: each interviewer's turn with the interviewees' turns up to the next; pairs without an answer are dropped."""
    order = Window.partitionBy(key).orderBy("pos")
    told = turns.withColumn("role", speaker_role(F.col("speaker"))).where("role is not null")
    numbered = told.withColumn("seg", F.sum(F.when(F.col("role") == "interviewer", 1).otherwise(0)).over(order)).where("seg > 0")
    replies = F.array_sort(F.collect_list(F.when(F.col("role") == "interviewee", F.struct("pos", "text"))))  # one stretch of one recording
    pairs = numbered.groupBy(key, "seg").agg(F.min_by("text", "pos").alias("question"), F.array_join(F.transform(replies, lambda x: x["text"]), " ").alias("answer")).where("answer != ''")
    return pairs.select(key, F.row_number().over(Window.partitionBy(key).orderBy("seg")).alias("pair_no"), "question", "answer")


def carry_topic(messages: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """``key, pos, prompt``: user messages; a follow-up is led by the last user message before it that is not blank."""
    said = normalize(F.coalesce("content", F.lit("")))
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    topic = F.last(F.when((F.col("role") == "user") & (said != ""), said), True).over(earlier)
    prompt = F.when((said != "") & is_follow_up(F.col("content")) & F.col("_topic").isNotNull(), F.concat(F.col("_topic"), F.lit("\nUser follow-up: "), F.col("content"))).otherwise(F.col("content"))
    return messages.withColumn("_topic", topic).where("role = 'user'").select(key, order, prompt.alias("prompt"))


def history_window(messages: DataFrame, key: str = "id", order: str = "pos", n: int = HISTORY) -> DataFrame:
    """``key, pos, history``: up to ``n`` messages before each, as lines of role and content."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
    return messages.select(key, order, F.array_join(F.collect_list(line).over(before), "\n").alias("history"))


def style_examples(messages: DataFrame, order: list[str], n: int = STYLE_EXAMPLES, chars: int = STYLE_CHARS, strict_compat: bool = False) -> DataFrame:
    """``pos, example``: the first assistant messages that are not blank, cut; with ``strict_compat`` none unless there are ``n``."""
    told = messages.where("role = 'assistant'").withColumn("_t", normalize(F.col("content"))).where("_t != ''")
    first = told.orderBy(*order).limit(n).select(*order, F.substring("_t", 1, chars).alias("example"))
    if strict_compat:
        return first.join(F.broadcast(first.agg(F.count(F.lit(1)).alias("_n"))).where(F.col("_n") >= n)).drop("_n")
    return first


def _style_block(examples: list[str]) -> str:
    return "\n\n".join(f"- {e}" for e in examples[:STYLE_EXAMPLES]) if examples else NO_STYLE


def augmented_prompt(prompt: Column, context: Column, examples: list[str]) -> Column:
    """The user message of an example with retrieved context."""
    return F.concat(
        F.lit("Detected intent type: "), intent(prompt), F.lit("\n\nUser question:\n"), prompt, F.lit("\n\nShort Canary style examples to preserve:\n" + _style_block(examples) + "\n\nRetrieved context:\n"),
        context, F.lit("\n\n" + AUGMENT_INSTRUCTIONS),
    )


def chat_prompt(prompt: Column, effective: Column, context: Column, examples: list[str]) -> Column:
    """The user message of a chat with retrieved context and resolved topic."""
    return F.concat(
        F.lit("Detected intent type: "), intent(effective), F.lit("\n\nUser question:\n"), prompt, F.lit("\n\nResolved query for memory and retrieval:\n"), effective,
        F.lit("\n\nShort Canary style examples to preserve:\n" + _style_block(examples) + "\n\nRetrieved context:\n"), context, F.lit("\n\n" + CHAT_INSTRUCTIONS),
    )


def with_system(messages: Column) -> Column:
    """Messages led by a system message: the own one with a suffix, or the default."""
    first = F.get(messages, F.lit(0))
    own = rx.strip(F.coalesce(first["content"], F.lit("")))
    led = (first["role"] == "system") & (own != "")
    rest = F.when(F.coalesce(led, F.lit(False)), F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    text = F.when(F.coalesce(led, F.lit(False)), F.concat(own, F.lit(SYSTEM_SUFFIX))).otherwise(F.lit(SYSTEM_PROMPT))
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), text.alias("content"))), rest)


def replace_last_user(messages: Column, content: Column) -> Column:
    """Messages with another content in the last one of the user."""
    back = F.array_position(F.transform(F.reverse(messages), lambda m: m["role"]), F.lit("user"))
    at = F.size(messages) - back
    return F.transform(messages, lambda m, i: F.when((back > 0) & (i == at), F.struct(m["role"].alias("role"), content.alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def last_user(messages: Column) -> Column:
    return rx.strip(F.coalesce(F.element_at(F.filter(messages, lambda m: m["role"] == "user"), -1)["content"], F.lit("")))


def render(messages: Column) -> Column:
    """Messages as text where there is no chat template."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.upper(F.coalesce(m["role"], F.lit(""))), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n\n")


def augment(rows: DataFrame, contexts: DataFrame, examples: list[str], key: str = "example_id") -> DataFrame:
    """Rows whose last user message became a prompt with context; ``contexts`` has ``key, context``.  Rows without a user message stay as they are."""
    from telar.operators.retrieval import NO_CONTEXT

    asked = rows.withColumn("_q", last_user(F.col("messages"))).join(contexts.select(key, "context"), key, "left")
    changed = replace_last_user(with_system(F.col("messages")), augmented_prompt(F.col("_q"), F.coalesce("context", F.lit(NO_CONTEXT)), examples))
    return asked.withColumn("messages", F.when(F.col("_q") != "", changed).otherwise(F.col("messages"))).drop("_q", "context")
