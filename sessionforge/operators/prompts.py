"""Prompt texts: instruction and context variants, item lines and the response contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_year
from .sessions import exploded

#: Instruction lines by variant; {noun} is what an item is called.
INSTRUCTIONS = {
    "baseline_scores_v1": ("Assign one relevance score from 0 to 100 to every candidate", "position according to how likely the user is to interact with that", "{noun} next. Higher scores mean stronger recommendations."),
    "wording_direct_v1": ("Give a direct next-item relevance score from 0 to 100 for every", "candidate position. Higher scores indicate that the user is more", "likely to interact with that {noun} next."),
    "wording_preference_v1": ("Estimate how well each candidate matches the user's {noun} preferences", "for the next interaction. Assign a score from 0 to 100, where higher", "scores mean a stronger match."),
    "wording_detailed_v1": ("Carefully compare the user's chronological history with every", "candidate and assign a score from 0 to 100 for likely next interaction.", "Use higher scores for stronger recommendations."),
    "next_step_v2": ("Look at the last few {noun}s the user chose. Score each candidate", "from 0 to 100 by how naturally it would come right after them, like", "the next part of a series or the obvious follow-up."),
    "long_term_taste_v2": ("Look at the whole history and find what the user likes again and", "again (type, style, theme). Score each candidate from 0 to 100 by how", "well it fits that lasting taste."),
    "closest_match_v2": ("For each candidate, find the one {noun} in the history it is most", "like. Score each candidate from 0 to 100 by how close that match is."),
    "rule_out_rank_v2": ("First give low scores (below 30) to candidates that clearly do not fit", "this user. Then score the remaining candidates from 30 to 100 by how", "well they fit."),
    "preference_enjoy_v2": ("Based on the user's history, how much would this user enjoy each", "candidate? Score from 0 (would not enjoy it) to 100 (would love it)."),
    "preference_pick_now_v2": ("Imagine you are this user and you just chose the {noun}s above. How", "much would you want to pick each candidate next? Score from 0 (not at", "all) to 100 (right away)."),
    "skip_risk_v2": ("For each candidate, think about how likely the user would skip or", "ignore it. Give 100 to candidates they would almost surely NOT skip,", "and 0 to ones they would surely skip."),
}
#: What a context says that its item lines show.
CONTEXTS = {
    "context_title_v1": "{noun} titles only",
    "context_genre_v1": "{noun} titles and genres",
    "context_rich_v1": "{noun} titles, genres, and release year",
    "context_content_v2": "{noun} title, genres, series, and year",
    "context_crowd_v2": "{noun} title, average rating, audience size, and rating trend",
    "context_personal_v2": "{noun} title, the user's own rating, how recent it is, and which of the user's most frequent genres it shares",
    "context_collab_v2": "{noun} title, the past {noun} it is most often chosen with by other users, how strong that link is compared with the other candidates, and the recent past {noun} it most often follows",
    "context_subgenre_v2": "{noun} title, its sub-genre, the wider category that sub-genre belongs to, and how many of the user's recent {noun}s share that sub-genre",
    "context_format_v2": "{noun} title, its format, its listed price, and whether that price is low, mid or high for this catalog",
}
FIELD_CONTEXTS = [c for c in CONTEXTS if c.endswith("_v2")]
#: The sets of variants that experiments use.
STRATEGY_SET = ["baseline_scores_v1", *[v for v in INSTRUCTIONS if v.endswith("_v2")]]
WORDING_SET = [v for v in INSTRUCTIONS if v.endswith("_v1")]
SEMANTIC_SET = ["context_content_v2", "context_crowd_v2", "context_personal_v2", "context_subgenre_v2", "context_format_v2"]
#: The system message and the text around the lists. {n} is the number of candidates.
SYSTEM = "You are a precise next-item {noun} recommendation system. Rank only the numbered candidate positions and follow the requested JSON format exactly."
OPENING = "The following {noun}s were previously interacted with by the user,\nlisted in chronological order:\n\n"
AFTER_HISTORY = "\n\nItem context format: {context}.\n\n{instructions}\n\nCandidate positions to rank (exactly {n} candidates):\n"
RULES = """

Rules:
- Return exactly {n} numeric scores in the scores array.
- Array entry 1 scores candidate position 1, entry 2 scores position 2, and so on through position {n}.
- Use only {evidence} for relevance; do not use the position number as the score.
- Score every candidate; do not stop early or return a top-k answer.
- Return only one JSON object; do not use Markdown or explanations.
- The JSON object must have exactly this shape:
{"scores": [50, 25, 75]}
- The example above only illustrates the key name; for this request, the scores array must contain all {n} numeric scores."""
TITLES_EVIDENCE, FIELDS_EVIDENCE = "the {noun} titles and history", "the item information shown and the history"


def _one_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\r\n", "  "))


def _filled(template: str, n: Column, **known: str) -> Column:
    """A template with its known parts put in and the number of candidates as a column."""
    for name, value in known.items():
        template = template.replace("{" + name + "}", value)
    out: list[Column] = []
    for i, part in enumerate(template.split("{n}")):
        out += [n, F.lit(part)] if i else [F.lit(part)]
    return F.concat(*out)


def checked(sessions: DataFrame) -> DataFrame:
    """Fails on a session without history or candidates, or with a candidate that repeats."""
    size, candidates = F.size("candidates"), F.col("candidates")
    bad = F.when(F.size("prefix") < 1, "no history").when(size < 1, "no candidates").when(F.size(F.array_distinct(candidates)) != size, "candidates repeat")
    return sessions.withColumn("candidates", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.col("session_id"))).cast(sessions.schema["candidates"].dataType)).otherwise(candidates))


def item_lines(sessions: DataFrame, items: DataFrame, context: str, fields: DataFrame | None) -> DataFrame:
    """session_id, history and choices: the numbered lines of both lists. An item without a title fails; one without
    fields (older history) shows its title alone."""
    missing = F.raise_error(F.concat(F.lit("no title for item "), F.col("item_id").cast("string"))).cast("string")
    title = F.coalesce(_one_line(F.col("title")), missing)
    genres = F.coalesce(F.nullif(_one_line(F.array_join("genres", "|")), F.lit("")), F.lit("(unknown)"))
    rows = sessions.select("session_id", F.lit("history").alias("side"), F.posexplode("prefix").alias("i", "item_id")).unionByName(sessions.select("session_id", F.lit("candidate").alias("side"), F.posexplode("candidates").alias("i", "item_id")))
    rows = exploded(rows).join(items.select("item_id", "title", "genres"), "item_id", "left")
    line = F.concat((F.col("i") + 1).cast("string"), F.lit(". title="), title)
    if context in FIELD_CONTEXTS:
        rows = rows.join(fields, ["session_id", "side", "item_id"], "left")
        line = F.concat(line, F.coalesce(F.concat(F.lit("; "), F.nullif("fields", F.lit(""))), F.lit("")))
    elif context != "context_title_v1":
        line = F.concat(line, F.lit("; genres="), genres)
        if context == "context_rich_v1":
            line = F.concat(line, F.lit("; release_year="), title_year(title))
    by = rows.groupBy("session_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("i", line.alias("line"))))).alias(name) for side, name in (("history", "history"), ("candidate", "choices"))])
    return by.select("session_id", *[F.array_join(F.transform(c, lambda x: x["line"]), "\n").alias(c) for c in ("history", "choices")])


def prompts(sessions: DataFrame, items: DataFrame, variants: list[str], context: str = "context_title_v1", noun: str = "movie", fields: DataFrame | None = None) -> DataFrame:
    """session_id, variant_id, context_variant_id, system_message and user_message for each of the variants.

    sessions: session_id, prefix (oldest first), candidates (as presented); the target isn't looked at. The lines of a
    context are made once and meet the variants' templates, which are literals."""
    for name, known in ((context, CONTEXTS), *((v, INSTRUCTIONS) for v in variants)):
        if name not in known:
            raise ValueError(f"unknown variant {name!r}; known: {', '.join(sorted(known))}")
    if context in FIELD_CONTEXTS and fields is None:
        raise ValueError(f"{context} needs fields")
    sessions = checked(sessions)
    lines = item_lines(sessions, items, context, fields).join(sessions.select("session_id", F.size("candidates").cast("string").alias("n")), "session_id")
    evidence = (FIELDS_EVIDENCE if context in FIELD_CONTEXTS else TITLES_EVIDENCE).replace("{noun}", noun)
    n = F.col("n")
    texts = []
    for v in variants:
        middle = _filled(AFTER_HISTORY, n, context=CONTEXTS[context].replace("{noun}", noun), instructions="\n".join(INSTRUCTIONS[v]).replace("{noun}", noun))
        user = F.concat(F.lit(OPENING.replace("{noun}", noun)), "history", middle, "choices", _filled(RULES, n, evidence=evidence))
        texts.append(F.struct(F.lit(v).alias("variant_id"), user.alias("user_message")))
    rows = lines.select("session_id", F.explode(F.array(*texts)).alias("t"))
    return rows.select("session_id", "t.variant_id", F.lit(context).alias("context_variant_id"), F.lit(SYSTEM.replace("{noun}", noun)).alias("system_message"), "t.user_message")
