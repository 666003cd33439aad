"""Prompt and answer text as Column expressions. Python's str methods are matched where they differ from Spark's: strip()
takes all Unicode white space, split() too, and a missing value is '' wherever the callers treat it so."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spelling alphabet, letter and its spellings; the first is the canonical one.
SPELLINGS = {
    "A": ("ALFA", "ALPHA"), "B": ("BRAVO",), "C": ("CHARLIE",), "D": ("DELTA",), "E": ("ECHO",), "F": ("FOXTROT",), "G": ("GOLF",),
    "H": ("HOTEL",), "I": ("INDIA",), "J": ("JULIET", "JULIETT"), "K": ("KILO",), "L": ("LIMA",), "M": ("MIKE",), "N": ("NOVEMBER",),
    "O": ("OSCAR",), "P": ("PAPA",), "Q": ("QUEBEC",), "R": ("ROMEO",), "S": ("SIERRA",), "T": ("TANGO",), "U": ("UNIFORM",),
    "V": ("VICTOR",), "W": ("WHISKEY",), "X": ("XRAY", "X-RAY"), "Y": ("YANKEE",), "Z": ("ZULU",),
}
# Colour words and the colours that they stand for.
COLOURS = {
    "red": "red", "crimson": "red", "scarlet": "red", "orange": "orange", "amber": "orange", "yellow": "yellow", "gold": "yellow",
    "green": "green", "lime": "green", "emerald": "green", "teal": "teal", "cyan": "teal", "turquoise": "teal", "aqua": "teal",
    "blue": "blue", "navy": "blue", "azure": "blue", "purple": "purple", "violet": "purple", "magenta": "magenta", "fuchsia": "magenta",
    "pink": "magenta",
}
# Number words.
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
}
# Camera instructions that end a prompt, in the order in which they are tried.
CAMERA = (
    " In portrait, static camera, no zoom, no pan.",
    " In portrait. Static camera.",
    " In portrait. Static Camera. No zoom.",
    " In portrait. Static Camera. No zoom, no pan.",
    " Static camera perspective, no zoom or pan.",
)
# Wording of training prompts.
PREFIXES = {
    "ti2v": "Use the provided puzzle image as the starting frame. ",
    "ti2i": "Use the provided puzzle image as input. ",
    "ti2ti": "Use the provided reasoning image as input. ",
    "ti2t": "Use the provided puzzle image to solve the task. ",
}
# Phrases of prompts that need no prefix.
MENTIONS = ("provided puzzle image", "provided maze image", "provided input image", "provided reasoning image")
# Prompts, suffixes, and characters that answers are freed of.
MAZE_PROMPT = "Use the provided maze image as input. Draw a red path connecting the two red endpoints without touching the black walls."
SFT_SUFFIX = "\nDo not output the thinking process. Output the answer directly."
GRPO_SUFFIX = "\nPlease think step by step and output your final answer within <answer>...</answer> tags."
ANSWER_TEMPLATE = "\n\nEnclose the final answer within <answer> </answer> tags, i.e., <answer>answer here</answer>.\nNote that using tools (e.g., python) is not allowed."
# The prompts of a visual puzzle by mode, with and without options.
PUZZLE_PROMPTS = {
    "ti2v": "Use the provided visual puzzle image as the starting frame. {question}",
    "ti2i": "Use the provided visual puzzle image as input. {question} Replace only the missing question-mark region with the correct answer while keeping every other shape unchanged. Output the solved image.",
    "ti2t": "Use the provided visual puzzle image to solve the task. {question} Options: [{options}]. Answer with exactly one option.",
    "ti2ti": "Use the provided visual puzzle image as input. {question} Options: [{options}]. First determine the correct option, then replace only the missing question-mark region with that answer while keeping every other shape unchanged. Output the solved image.",
}
OPEN_PUZZLE_PROMPTS = {
    "ti2t": "Use the provided visual puzzle image to solve the task. {question} Answer with the final answer only.",
    "ti2ti": "Use the provided visual puzzle image as input. {question} First determine the missing answer, then replace only the missing question-mark region with that answer while keeping every other shape unchanged. Output the solved image.",
}
STRIPPED = " \t\r\n\"'`.,;:!?()[]{}"

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(table: dict[str, object], key: Column) -> Column:
    """The value of a literal table, null where the key is missing."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def blank(x: Text) -> Column:
    return F.coalesce(col(x), F.lit(""))


def missing(x: Text) -> Column:
    """Null where Python's `or` would go on: null and ''."""
    return F.nullif(col(x), F.lit(""))


def strip(x: Text) -> Column:
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def collapse(x: Text) -> Column:
    """T4: runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(blank(x), r"(?U)\s+", " "))


def present(x: Text) -> Column:
    """strip(), and null if nothing is left."""
    return missing(strip(x))


def spelled_letter(x: Text) -> Column:
    """Letter of the first spelling-alphabet word; else the first token that is a single letter."""
    table = {v: letter for letter, spellings in SPELLINGS.items() for v in spellings}
    tokens = F.transform(F.regexp_extract_all(blank(x), F.lit("[A-Za-z]+(?:-[A-Za-z]+)?"), F.lit(0)), F.upper)
    word = F.get(F.filter(tokens, lambda t: t.isin(list(table))), 0)
    return F.coalesce(lookup(table, word), F.get(F.filter(tokens, lambda t: F.length(t) == 1), 0))


def spelled_word(x: Text) -> Column:
    """Canonical spelling of T1."""
    return lookup({k: v[0] for k, v in SPELLINGS.items()}, spelled_letter(x))


def plain_prompt(x: Text) -> Column:
    """Without speaking, portrait and camera instructions; ends in a period unless empty."""
    out = blank(x)
    for pattern in (r"\s*Speak out[^.]*\.[^.]*\.", r"\s*In portrait[^.]*\.", r"\s*Static camera\."):
        out = F.regexp_replace(out, "(?i)" + pattern, "")
    out = collapse(out)
    return F.when((out != "") & ~out.endswith("."), F.concat(out, F.lit("."))).otherwise(out)


def image_prompt(x: Text, mode: str | Column) -> Column:
    """T5: a prompt that says which image it is about."""
    text = collapse(x)
    mention = F.lit(False)
    for phrase in MENTIONS:
        mention = mention | F.contains(F.lower(text), F.lit(phrase))
    prefix = F.lit(PREFIXES.get(mode, "")) if isinstance(mode, str) else F.coalesce(lookup(PREFIXES, mode), F.lit(""))
    return F.when((text == "") | mention, text).otherwise(F.concat(prefix, text))


def _unlabelled(text: Column) -> Column:
    return F.when(F.lower(text).startswith("answer:"), strip(F.substring(text, F.lit(8), F.length(text)))).otherwise(text)


def answer_sentence(x: Text) -> Column:
    """`Answer: X.` of an answer; '' stays ''."""
    text = strip(blank(x))
    body = F.rtrim(_unlabelled(text), F.lit("."))
    body = F.when(body.rlike(r"^\p{L}"), F.concat(F.upper(F.left(body, F.lit(1))), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    return F.when(text == "", "").otherwise(F.concat(F.lit("Answer: "), body, F.lit(".")))


def answer_body(x: Text) -> Column:
    """What T6 wraps."""
    return strip(F.rtrim(_unlabelled(strip(blank(x))), F.lit(".")))


def training_prompt(group: Text, x: Text) -> Column:
    """Training prompt by task group."""
    g = col(group)
    return F.when(g == "maze", MAZE_PROMPT).when(g == "eyeballing", image_prompt(plain_prompt(x), "ti2i")).when(g == "visual_puzzle", image_prompt(x, "ti2v")).otherwise(image_prompt(x, "ti2i"))


def chat_prompt(x: Text, mode: Text) -> Column:
    """User turn of a chat row."""
    return strip(F.concat(F.lit("<image> "), blank(x), F.when(col(mode) == "sft", SFT_SUFFIX).otherwise(GRPO_SUFFIX)))


def without_camera(x: Text) -> Column:
    """Without the first camera instruction that ends it."""
    text = strip(x)
    out = text
    for suffix in reversed(CAMERA):
        out = F.when(text.endswith(suffix), strip(F.left(text, F.length(text) - len(suffix)))).otherwise(out)
    return out


def reward_answer(x: Text) -> Column:
    """Inside the last <answer> and the next close if both tags exist, else the whole text."""
    text = blank(x)
    tail = F.substring_index(text, "<answer>", -1)
    inside = F.contains(text, F.lit("<answer>")) & F.contains(tail, F.lit("</answer>"))
    return strip(F.when(inside, F.substring_index(tail, "</answer>", 1)).otherwise(text))


def tagged_answer(x: Text) -> Column:
    """Inside the last <answer> tag and the next close, in any case; null if either is missing."""
    text = col(x)
    low = F.lower(text)
    start = F.length(low) - F.length(F.substring_index(low, "<answer>", -1))
    tail, low_tail = F.substring(text, start + 1, F.length(text)), F.substring(low, start + 1, F.length(text))
    stop = F.locate("</answer>", low_tail)
    return F.when(F.contains(low, F.lit("<answer>")) & (stop > 0), strip(F.left(tail, stop - 1)))


def free_text(x: Text) -> Column:
    """Normal form in which answers are compared."""
    text = F.regexp_replace(F.lower(reward_answer(x)), r"(?U)^answer\s*:\s*", "")
    return F.regexp_replace(F.btrim(text, F.lit(STRIPPED)), r"(?U)\s+", " ")


def last_number(x: Text) -> Column:
    """The last number, of the bold spans if there are any `**`; else the last number word."""
    text = blank(x)
    own = F.when(F.contains(text, F.lit("**")), F.array_join(F.regexp_extract_all(text, F.lit(r"\*\*(.*?)\*\*"), F.lit(1)), " ")).otherwise(text)
    digits = F.try_element_at(F.regexp_extract_all(own, F.lit(r"\b\d+\b"), F.lit(0)), F.lit(-1))
    words = F.filter(F.regexp_extract_all(F.lower(own), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(list(NUMBERS)))
    return F.coalesce(digits.try_cast("bigint"), lookup(NUMBERS, F.try_element_at(words, F.lit(-1))).cast("bigint"))


def colour_order(x: Text, palette: Text) -> Column:
    """Colours named after the last </think>, first mentions only, of the palette, as many as it has."""
    words = F.regexp_extract_all(F.lower(F.substring_index(blank(x), "</think>", -1)), F.lit("[a-z]+"), F.lit(0))
    named = F.transform(F.filter(words, lambda w: w.isin(list(COLOURS))), lambda w: lookup(COLOURS, w))
    return F.slice(F.array_distinct(F.filter(named, lambda c: F.array_contains(col(palette), c))), 1, F.greatest(F.size(col(palette)), F.lit(1)))


def _integers(inside: Column) -> Column:
    return F.filter(F.transform(F.split(inside, ","), strip), lambda t: t.rlike(r"^-*[0-9]+$"))


def reward_path(x: Text) -> Column:
    """T16, reward: integers of the first [...] of the answer; null without brackets or if a token such as --5 is no integer."""
    inside = F.regexp_extract(reward_answer(x), r"(?s)\[(.*?)\]", 1)
    tokens = _integers(inside)
    numbers = F.transform(tokens, lambda t: t.try_cast("bigint"))
    return F.when(reward_answer(x).rlike(r"(?s)\[.*?\]") & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def last_path(x: Text) -> Column:
    """T16, reconstruction: integers of the last [digits, ...]; null without one."""
    found = F.try_element_at(F.regexp_extract_all(blank(x), F.lit(r"\[\s*(\d+(?:\s*,\s*\d+)*\s*,?\s*)\]"), F.lit(1)), F.lit(-1))
    return F.when(found.isNotNull(), F.transform(F.filter(F.transform(F.split(found, ","), strip), lambda t: t != ""), lambda t: t.try_cast("bigint")))


def linked_url(x: Text) -> Column:
    """First address in parentheses, without them; null if none."""
    return missing(F.regexp_extract(blank(x), r"\((https?://[^\s)]+)\)", 1))


def file_name(x: Text, index: Text) -> Column:
    """Safe video name."""
    base = F.btrim(F.regexp_replace(blank(x), "[^0-9A-Za-z_-]+", "_"), F.lit("_"))
    return F.concat(F.when(base == "", F.concat(F.lit("entry_"), col(index).cast("string"))).otherwise(base), F.lit(".mp4"))


def hex_colour(rgb: Text) -> Column:
    """#rrggbb of three numbers, else null."""
    two = lambda k: F.lpad(F.lower(F.hex(F.get(col(rgb), k))), 2, "0")
    return F.when(F.size(col(rgb)) == 3, F.concat(F.lit("#"), two(0), two(1), two(2)))


def question_text(question: Text, options: Text) -> Column:
    """Question, its options and the answer template."""
    own = F.when(F.coalesce(F.size(col(options)), F.lit(0)) > 0, F.concat(F.lit("\nOptions: "), F.array_join(col(options), ", "))).otherwise("")
    return F.concat(col(question), own, F.lit(ANSWER_TEMPLATE))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with columns in place of its {names}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def puzzle_prompts(question: Text, options: Text, instruction: str = "", common: str = "") -> dict[str, Column]:
    """Prompts of the four modes; blank options are left out, and so are blanks in place of what is missing in ti2v."""
    q = strip(blank(question))
    listed = F.array_join(F.filter(F.transform(F.coalesce(col(options), F.array().cast("array<string>")), strip), lambda o: o != ""), ", ")
    own = {m: filled(t, {"question": q, "options": listed}) for m, t in PUZZLE_PROMPTS.items()}
    for mode, template in OPEN_PUZZLE_PROMPTS.items():
        own[mode] = F.when(listed != "", own[mode]).otherwise(filled(template, {"question": q}))
    more = [F.lit(p.strip()) for p in (instruction, common) if p.strip()]
    own["ti2v"] = strip(F.concat_ws(" ", strip(own["ti2v"]), *more))
    return own


def judge_request(question: Text, answer: Text, transcript: Text) -> Column:
    """What a judge is asked; the call itself is outside."""
    return F.concat(F.lit("Question: "), col(question), F.lit("\n\nCorrect answer: "), col(answer), F.lit("\n\nTranscript: "), blank(transcript))


def judge_verdict(response: Text) -> Column:
    """Yes, no, or error without a response."""
    return F.when(col(response).isNull(), "error").when(F.contains(F.lower(col(response)), F.lit("yes")), "yes").otherwise("no")


def first_id(*ids: Text) -> Column:
    """First id that is neither null, '' nor 0."""
    return F.coalesce(*(F.when(~col(x).cast("string").isin("", "0"), col(x).cast("string")) for x in ids))


def solution_text(group: Text, path: Text, option: Text) -> Column:
    """Maze paths as a JSON list with ', ', without one [], options of eyeballing tasks in upper case, others as they are; stripped."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(col(path), lambda c: c.cast("string")), ", "), F.lit("]"))
    listed, chosen = F.coalesce(listed, F.lit("[]")), strip(blank(option))
    return F.when(col(group) == "maze", listed).when(col(group) == "eyeballing", F.upper(chosen)).otherwise(chosen)


def answer_text(given: Text, group: Text, path: Text, option: Text) -> Column:
    """What a sample answers: its own text, stripped, and without one the solution."""
    return F.coalesce(present(given), solution_text(group, path, option))


def option(x: Text) -> Column:
    """A stripped single letter in upper case, else T1."""
    text = strip(x)
    return F.when(text.rlike(r"^\p{L}$"), F.upper(text)).otherwise(spelled_letter(x))
