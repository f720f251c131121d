"""Instruction rows as chat messages in nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.text import strip
from reportlake.operators.joins import split_heavy
from reportlake.session import stage



def element(kind: str, text: Column | None = None, path: Column | None = None) -> Column:
    """One content element; all four fields are always there."""
    return F.struct(
        F.lit(kind).alias("type"),
        (text if text is not None else F.lit("")).alias("text"),
        F.lit(None).cast("binary").alias("image"),
        (path if path is not None else F.lit("")).alias("image_path"),
    )


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def gemma_messages(instruction: Column, response: Column, images: Column, prompt: Column) -> Column:
    """System, user (images then text), assistant; no image gives no message."""
    shown = F.transform(images, lambda p: element("image", path=p))
    messages = F.array(
        turn("system", F.array(element("text", prompt))),
        turn("user", F.concat(shown, F.array(element("text", instruction)))),
        turn("assistant", F.array(element("text", response))),
    )
    return F.when(F.size(images) > 0, messages).otherwise(F.filter(messages, lambda m: F.lit(False)))


def qwen_messages(instruction: Column, response: Column, images: Column, prompt: Column) -> Column:
    """User (image list, text), assistant text."""
    return F.array(
        turn(
            "user",
            F.array(
                F.struct(F.lit("image").alias("type"), images.alias("image"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("text").alias("type"), F.lit(None).cast("array<string>").alias("image"), instruction.alias("text")),
            ),
        ),
        turn(
            "assistant",
            F.array(
                F.struct(F.lit("text").alias("type"), F.lit(None).cast("array<string>").alias("image"), response.alias("text")),
            ),
        ),
    )


def qwen_url_messages(instruction: Column, response: Column, images: Column, prompt: Column) -> Column:
    """JSON text, because the content is a list in one turn and a string in the other."""
    user = F.to_json(
        F.struct(
            F.lit("user").alias("role"),
            F.array(
                F.struct(
                    F.lit("image_url").alias("type"),
                    F.struct(images.alias("url")).alias("image_url"),
                    F.lit(None).cast("string").alias("text"),
                ),
                F.struct(
                    F.lit("text").alias("type"),
                    F.lit(None).cast("struct<url:array<string>>").alias("image_url"),
                    instruction.alias("text"),
                ),
            ).alias("content"),
        )
    )
    answer = F.to_json(F.struct(F.lit("assistant").alias("role"), response.alias("content")))
    return F.concat(F.lit("["), user, F.lit(","), answer, F.lit("]"))


def llava_messages(instruction: Column, response: Column, images: Column, prompt: Column) -> Column:
    """Human / gpt pairs; the images stay in their own column."""
    return F.array(
        F.struct(F.lit("human").alias("from"), F.concat(F.lit("<image>\n"), instruction).alias("value")),
        F.struct(F.lit("gpt").alias("from"), response.alias("value")),
    )


# all formatters share one signature.
FORMATTERS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "gemma": gemma_messages,
    "qwen25vl": qwen_messages,
    "qwen25vl_url": qwen_url_messages,
    "llava15": llava_messages,
}


def formatter(name: str) -> Callable[[Column, Column, Column, Column], Column]:
    if name not in FORMATTERS:
        raise ValueError(f"unknown formatter {name!r}; known: {sorted(FORMATTERS)}")
    return FORMATTERS[name]


def messages_from_columns(df: DataFrame) -> Column:
    """Chat messages from whichever loose columns the table has.

    ``messages`` is passed through. Else images, then videos, then ``text`` or
    ``question`` make the user turn, and ``answer`` or ``response`` the reply.
    """
    has = set(df.columns)
    if "messages" in has:
        return F.col("messages")
    field = "struct<type:string,image:string,video:string,text:string>"

    def listed(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        column = F.col(name)
        return column if kind == "array" else F.when(column.isNotNull(), F.array(column))

    def item(kind: str, **value: Column) -> Column:
        parts = [F.lit(kind).alias("type")]
        parts += [value.get(n, F.lit(None)).cast("string").alias(n) for n in ("image", "video", "text")]
        return F.struct(*parts).cast(field)

    none = F.array().cast(f"array<{field}>")
    content = [none]
    if "images" in has:
        located = lambda p: F.when(p.startswith("data:image") | p.startswith("http"), p).otherwise(
            F.concat(F.lit("file://"), p)
        )
        content.append(F.coalesce(F.transform(listed("images"), lambda p: item("image", image=located(p))), none))
    if "videos" in has:
        content.append(F.coalesce(F.transform(listed("videos"), lambda v: item("video", video=v)), none))
    said = next((n for n in ("text", "question") if n in has), None)
    if said:
        content.append(F.array(item("text", text=F.col(said))))
    turns = [turn("user", F.concat(*content))]
    reply = next((n for n in ("answer", "response") if n in has), None)
    if reply:
        turns.append(turn("assistant", F.array(item("text", text=F.col(reply)))))
    return F.array(*turns)


def flatten_content(messages: Column | str, max_images: Column) -> Column:
    """Turns reduced to text and image chunks.

    Texts are stripped and empty ones dropped; an image is kept when its place
    in the content lies below ``max_images``; turns left without a chunk go.
    """

    def chunk(e: Column, i: Column) -> Column:
        text = F.when((e["type"] == "text") & (F.length(e["text"]) > 0), strip(e["text"]))
        image = F.when((e["type"] == "image") & (i < max_images), e["image_path"])
        return F.struct(e["type"].alias("type"), text.alias("text"), image.alias("image"))

    turns = F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.filter(
                F.transform(m["content"], chunk), lambda c: c["text"].isNotNull() | c["image"].isNotNull()
            ).alias("content"),
        ),
    )
    return F.filter(turns, lambda m: F.size(m["content"]) > 0)


def vision_elements(messages: Column | str) -> Column:
    """Every image or video element of a conversation, in order."""
    return F.filter(
        F.flatten(F.transform(messages, lambda m: m["content"])),
        lambda e: e["type"].isin("image", "image_url", "video"),
    )


def drop_system(messages: Column | str) -> Column:
    """By role, wherever the system turn stands."""
    return F.filter(messages, lambda m: m["role"] != "system")


def first_valid(images: Column | str, is_valid: Callable[[Column], Column], most: int = 2) -> Column:
    """The first ``most`` images that pass the check."""
    return F.slice(F.filter(images, is_valid), 1, most)


def pad_or_cut(ids: Column | str, length: int, pad: int = 0) -> Column:
    """Exactly ``length`` ids, padded on the right."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def mask_ids(ids: Column | str, hidden: list[int], mask: int = -100) -> Column:
    """Labels, with pad and image ids hidden."""
    return F.transform(ids, lambda x: F.when(x.isin(*hidden), F.lit(mask)).otherwise(x))


def hidden_ids(vocabulary: dict[str, int], image_tokens: list[str], pad: int | None = None) -> list[int]:
    """The ids to hide, from the tokens that the vocabulary knows."""
    ids = {vocabulary[t] for t in image_tokens if t in vocabulary}
    return sorted(ids | ({pad} if pad is not None else set()))


def pad_batches(df: DataFrame, batch: str, ids: str = "input_ids", pad: int = 0) -> DataFrame:
    """Pad to the longest row of the batch and add ``attention_mask``.

    The window holds one batch, whose size the batch plan bounds.
    """
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    gap = F.col("_longest") - F.size(ids)
    return (
        df.withColumn("_longest", longest)
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)),
        )
        .withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), gap)))
        .drop("_longest")
    )


def sequence_texts(json_text: Column, columns: dict[str, str], item: str) -> list[Column]:
    """First item's text of each JSON sequence, aligned by key."""
    return [F.get_json_object(json_text, f"$.{k}[0].{item}").alias(n) for k, n in columns.items()]


def flat_report(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Nested report columns as one flat row; ``fields`` maps output to path."""
    return df.select(*[F.col(path).alias(name) for name, path in fields.items()])


def resolve_images(
    df: DataFrame, key: str, messages: str, files: DataFrame, moved: tuple[str, str] | None = None
) -> DataFrame:
    """Contents of the first turn's images, from a (path, content) table.

    ``moved`` names a folder and the one to look in when a path is not there.
    Rows for which no image is found are dropped. Adds ``pictures`` in order.
    Paths are settled on the listing alone; contents are read last, for the
    paths that were chosen.
    """
    first = F.filter(F.get(messages, F.lit(0))["content"], lambda e: e["type"] == "image")
    wanted = df.select(key, F.posexplode(F.transform(first, lambda e: e["image_path"])).alias("_pos", "_want"))
    tries = F.array(F.struct(F.lit(0).alias("_try"), F.col("_want").alias("path")))
    if moved:
        other = F.replace("_want", F.lit(moved[0]), F.lit(moved[1]))
        again = F.when(other != F.col("_want"), F.array(F.struct(F.lit(1).alias("_try"), other.alias("path"))))
        tries = F.concat(tries, F.coalesce(again, F.filter(tries, lambda _: F.lit(False))))
    # one picture may stand in most rows
    tried = stage(wanted.select(key, "_pos", F.inline(tries)), "wanted")
    found = split_heavy(tried, files.select("path").distinct(), ["path"], "left_semi")
    # of two places the original one counts
    best = found.groupBy(key, "_pos").agg(F.min_by("path", "_try").alias("path"))
    named = split_heavy(best, files.select("path", "content"), ["path"], "inner", keys=tried.select("path"))
    listed = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "content"))).alias("_found"))
    joined = df.join(listed, key, "inner")
    return joined.withColumn("pictures", F.transform("_found", lambda s: s["content"])).drop("_found")


ROW_BYTES = 256 << 20  # image bytes that one row may carry


def with_image_bytes(df: DataFrame, key: str, files: DataFrame, messages: str = "messages", most_bytes: int = ROW_BYTES) -> DataFrame:
    """N1 with bytes: image elements carry their content in ``image`` and no path, as the reader of files gives them.

    ``files`` is (path, length, content). Until the end, messages carry paths only: paths are looked up in the
    listing, a row's bytes are summed there, and contents join last, once for each row and path. An image that is not
    there is left out; a row without any image gets empty messages. A row that would pass ``most_bytes`` keeps the
    paths of its images, and ``oversized`` tells so. Keys are unique; null messages stay null.
    """
    is_image = lambda e: e["type"] == "image"
    paths = F.flatten(F.transform(messages, lambda m: F.transform(F.filter(m["content"], is_image), lambda e: e["image_path"])))
    wanted = stage(df.select(key, F.explode(F.array_distinct(paths)).alias("path")), "wanted")
    # one picture may stand in most rows
    found = split_heavy(wanted, files.select("path", F.col("length").cast("bigint").alias("_length")), ["path"], "inner")
    rows = found.groupBy(key).agg(F.sum("_length").alias("_bytes"), F.collect_list("path").alias("_paths"))
    rows = stage(rows.withColumn("oversized", F.col("_bytes") > int(most_bytes)), "found")
    fitting = rows.filter(~F.col("oversized")).select(key, F.explode("_paths").alias("path"))
    named = split_heavy(fitting, files.select("path", "content"), ["path"], "inner", keys=wanted.select("path"))
    contents = named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("_contents"))
    joined = df.join(rows.select(key, "oversized", "_paths"), key, "left").join(contents, key, "left")

    def shown(e: Column) -> Column:
        held = F.struct(
            e["type"].alias("type"), e["text"].alias("text"), F.col("_contents")[e["image_path"]].alias("image"),
            F.when(F.col("oversized"), e["image_path"]).otherwise(F.lit("")).alias("image_path"),
        )
        return F.when(is_image(e), held).otherwise(e)

    def there(m: Column) -> Column:
        content = F.filter(m["content"], lambda e: ~is_image(e) | F.array_contains("_paths", e["image_path"]))
        return F.struct(m["role"].alias("role"), F.transform(content, shown).alias("content"))

    full = F.when(F.col("_paths").isNotNull(), F.transform(messages, there)).otherwise(F.filter(messages, lambda m: F.lit(False)))
    return joined.withColumn(messages, full).withColumn("oversized", F.coalesce("oversized", F.lit(False))).drop("_paths", "_contents")
