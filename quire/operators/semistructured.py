"""Text that carries structure: outlines in Markdown, server-sent events, JSON inside text, quizzes and conversations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx


def outline_entries(files: DataFrame) -> DataFrame:
    """(book_id, physical_page, printed_page, label fields) for each level-3 heading of an outline. files: book_id, value.

    A heading holds the physical page and, in brackets, the printed one; the lines ``- **label**: value`` below it belong to it.
    """
    blocks = files.select("book_id", F.explode(F.slice(F.split("value", "(?m)^### "), 2, 1 << 30)).alias("block"))
    head = F.split_part("block", F.lit("\n"), F.lit(1))
    field = lambda name: F.regexp_extract("block", f"(?m)^- \\*\\*{name}\\*\\*:[ \\t]*(.*)$", 1)
    pages = F.regexp_extract(tx.normalise_digits(head), "([0-9]+)", 1), F.regexp_extract(tx.normalise_digits(head), "\\(.*?([0-9]+).*?\\)", 1)
    return blocks.select("book_id", *(F.when(p != "", p.cast("int")).alias(n) for p, n in zip(pages, ("physical_page", "printed_page"), strict=True)), *(field(n).alias(n) for n in ("type", "title", "description", "evidence")))


def outline_counts(files: DataFrame) -> DataFrame:
    return files.select("book_id", F.regexp_count("value", F.lit("(?m)^### ")).alias("entries"))


def without_negative_sentences(c: Column, negative: str = "(?i)(no text|not readable|cannot|needs a look)", has_text: Column | None = None, least: int = 60) -> Column:
    """The sentences that claim something; without text on the page only if ``least`` characters of them are left."""
    kept = F.array_join(F.filter(tx.sentences(c), lambda s: ~s.rlike(negative)), " ")
    enough = F.length(kept) >= least
    return F.when(~F.coalesce(c, F.lit("")).rlike(negative), tx.clean(c)).when(enough if has_text is None else has_text | enough, kept).otherwise("")


def sse_events(streams: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, at, event, data) of server-sent event streams; blocks end with an empty line, and the last one may lack it."""
    blocks = streams.select(key, F.posexplode(F.split(raw, "\r?\n\r?\n")).alias("at", "block")).where(tx.strip(F.col("block")) != "")
    data = F.array_join(F.regexp_extract_all("block", F.lit("(?m)^data:[ ]?(.*?)\r?$"), 1), "\n")
    event = F.regexp_extract("block", "(?m)^event:[ ]?(.*?)\r?$", 1)
    return blocks.select(key, "at", F.when(event == "", "message").otherwise(event).alias("event"), data.alias("data"))


def assembled_calls(fragments: DataFrame, key: str = "stream") -> DataFrame:
    """(key, call, name, arguments) from the fragments of tool calls (key, at, call, name, arguments), joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "name", "arguments")))
    rows = fragments.groupBy(key, "call").agg(ordered.alias("f"))
    named = F.get(F.filter(F.transform("f", lambda x: x["name"]), lambda n: n != ""), F.lit(0))
    return rows.select(key, "call", named.alias("name"), F.array_join(F.transform("f", lambda x: F.coalesce(x["arguments"], F.lit(""))), "").alias("arguments"))


def unwrapped(c: Column) -> Column:
    """The ``text`` of JSON that was stored as text, also where raw line ends or a missing end make it invalid.

    Escapes are taken out before the text's end is looked for, so that no pattern has to step over them one by one.
    """
    whole = F.get_json_object(c, "$.text")
    hidden = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\ue000")), F.lit('\\"'), F.lit("\ue001"))
    broken = F.regexp_extract(hidden, '(?s)"text"[ \\t\\n]*:[ \\t\\n]*"([^"]*)', 1)
    plain = F.translate(F.replace(broken, F.lit("\\n"), F.lit("\n")), "\ue000\ue001", '\\"')
    return F.when(~c.rlike(tx.SERIALISED), c).otherwise(F.coalesce(whole, F.when(broken != "", plain), c))


def fenced_json(c: Column) -> Column:
    """The JSON object in a model's answer: inside a fence, else from the first brace to the last."""
    fence = F.regexp_extract(c, "(?s)```(?:json)?[ \\t]*\n(.*?)```", 1)
    brace = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    return F.when(fence != "", tx.strip(fence)).when(brace != "", brace)


def canonical(map_column: Column) -> Column:
    """JSON of a map with its keys in order: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(map_column))))


_QUIZ = "array<struct<question:string,options:array<string>,answer:string>>"


def quiz_questions(c: Column) -> Column:
    """The valid questions of a quiz: text, two options or more, and an answer that is an option or an option's index."""
    parsed = F.coalesce(F.from_json(F.get_json_object(c, "$.questions"), _QUIZ), F.from_json(c, _QUIZ))
    place = lambda q: F.coalesce(q["answer"].try_cast("int"), F.array_position(q["options"], q["answer"]).cast("int") - 1)
    ok = lambda q: (F.coalesce(q["question"], F.lit("")) != "") & (F.size(q["options"]) >= 2) & place(q).between(0, F.size(q["options"]) - 1)
    return F.transform(F.filter(parsed, ok), lambda q: F.struct(q["question"].alias("question"), q["options"].alias("options"), place(q).alias("answer_at")))


_PARTS = "array<struct<type:string,text:string,image_url:struct<url:string>>>"


def text_of(content: Column) -> Column:
    """A message's text: the content itself, or the text parts of a JSON array, a line each."""
    parts = F.from_json(content, _PARTS)
    return F.when(content.rlike("^[ \\t\\n]*\\["), F.coalesce(F.array_join(F.filter(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), lambda t: t.isNotNull()), "\n"), F.lit(""))).otherwise(content)


def images_of(content: Column, most: int = 1_500_000) -> Column:
    """The image parts of a message that are PNG, JPEG or WebP data URLs of at most ``most`` characters."""
    urls = F.transform(F.filter(F.from_json(content, _PARTS), lambda p: p["type"] == "image_url"), lambda p: p["image_url"]["url"])
    return F.coalesce(F.filter(urls, lambda u: u.rlike("^data:image/(png|jpe?g|webp);base64,[A-Za-z0-9+/=]+$") & (F.length(u) <= most)), F.array().cast("array<string>"))


def history(conversations: DataFrame, roles: tuple = ("user", "assistant"), most: int = 4000) -> DataFrame:
    """The turns that are kept of a conversation, their text cut to ``most`` characters; empty, abandoned and incomplete ones go.

    A column ``model_content`` that isn't null goes before the text; columns ``abandoned`` and ``incomplete`` are read where they are.
    """
    has = conversations.columns
    body = text_of(F.coalesce("model_content", "text") if "model_content" in has else F.col("text"))
    gone = F.lit(False)
    for c in ("abandoned", "incomplete"):
        gone = gone | F.coalesce(F.col(c), F.lit(False)) if c in has else gone
    rows = conversations.where(F.col("role").isin(*roles) & ~gone).select("conv_id", "turn", "role", F.substring(body, 1, most).alias("text"))
    return rows.where(tx.strip(F.col("text")) != "")


def messages(raw: Column, most: int = 8000) -> Column:
    """A conversation's messages, read from JSON: known roles only, ids and texts cleaned and cut; null and bad JSON give none."""
    read = F.from_json(raw, "array<struct<id:string,role:string,content:string>>")
    good = F.filter(F.coalesce(read, F.from_json(F.lit("[]"), "array<struct<id:string,role:string,content:string>>")), lambda m: m["role"].isin("user", "assistant") & (tx.strip(F.coalesce(m["content"], F.lit(""))) != ""))
    return F.transform(good, lambda m: F.struct(safe_id(m["id"]).alias("id"), m["role"].alias("role"), F.substring(m["content"], 1, most).alias("text")))


def latest(conversations: DataFrame) -> DataFrame:
    """(conv_id, last_turn, last_role): conversations by their last turn, the latest first, then by id."""
    return conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role")).orderBy(F.desc("last_turn"), "conv_id")


def safe_id(c: Column, most: int = 64, fallback: str = "default") -> Column:
    kept = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, most)
    return F.when(kept == "", fallback).otherwise(kept)
