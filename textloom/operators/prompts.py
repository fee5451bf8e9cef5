"""Prompts from templates and a glossary, as column expressions and for single tasks.

A template names its places as ``{name}``; doubled braces stand for single ones. The templates here are our own; a file
of the stored form (name to role and content) replaces them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import strip

_RULES = "Keep every id as it is. Keep all tags and attributes, data-mmg-id among them. Return as many objects as you were given, in order."

TEMPLATES: dict[str, str] = {
    "json_batch_system_prompt": "You translate the HTML in a JSON array from {source_lang} to {target_lang}.",
    "json_batch_user_prompt": f"Rules: {_RULES} Translate only what stands between tags in html_content.\n{{glossary_section}}\n\nINPUT:\n{{json_task_string}}",
    "html_split_part_system_prompt": "You translate HTML from {source_lang} to {target_lang}.",
    "html_split_part_user_prompt": "Rules: Keep all tags and attributes. Return bare HTML.\n{glossary_section}\n\nINPUT:\n{html_content}",
    "json_subtitle_system_prompt": 'You translate subtitles in a JSON array from {source_lang} to {target_lang}. What you can\'t translate you return in brackets, as in {{"id": "seg_1", "text": "[as it was]"}}.',
    "json_subtitle_user_prompt": f"Rules: {_RULES} Translate only the text fields.\n{{glossary_section}}\n\nINPUT:\n{{json_task_string}}",
    "glossary_injection_template": "\nGLOSSARY: use these translations.\n{glossary_items}\n",
    "book_prompt": 'You translate a chapter of "{book_title}" from {source_lang} to {target_lang}. Tone: {tone_style}. Style: {writing_style}.\n{glossary_section}\n\nINPUT:\n{task_list_json}',
}


@dataclass(frozen=True)
class TaskPrompt:
    """Which templates a kind of task takes, and the place its payload has in them."""

    system: str
    user: str
    payload: str


# The kinds of tasks and the names of their templates and places.
PROMPTS = {
    "json_batch": TaskPrompt("json_batch_system_prompt", "json_batch_user_prompt", "json_task_string"),
    "split_part": TaskPrompt("html_split_part_system_prompt", "html_split_part_user_prompt", "html_content"),
    "fix_batch": TaskPrompt("html_split_part_system_prompt", "html_split_part_user_prompt", "html_content"),
    "json_subtitle_batch": TaskPrompt("json_subtitle_system_prompt", "json_subtitle_user_prompt", "json_task_string"),
}


def load_templates(path: str) -> dict[str, str]:
    """The templates of a JSON file of name to ``{role, content}``, over our own."""
    with open(path, encoding="utf-8") as f:
        return TEMPLATES | {k: v.get("content", "") for k, v in json.load(f).items()}


def load_glossary(path: str) -> dict[str, str]:
    """The terms of a JSON object; what isn't text is left out."""
    with open(path, encoding="utf-8") as f:
        return {k: v for k, v in json.load(f).items() if isinstance(v, str)}


def glossary_section(glossary: dict[str, str] | None, templates: dict[str, str] | None = None) -> str:
    """A line for each term, in order, in the glossary template; empty without terms."""
    if not glossary:
        return ""
    lines = "\n".join(f'* "{term}": "{translation}"' for term, translation in glossary.items())
    return (templates or TEMPLATES)["glossary_injection_template"].replace("{glossary_items}", lines)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with each place replaced by a column; places come from the template alone, never from a value."""
    parts: list[Column] = []
    text, i = "", 0
    while i < len(template):
        if template[i : i + 2] in ("{{", "}}"):
            text, i = text + template[i], i + 2
        elif template[i] == "{":
            end = template.index("}", i)
            parts += [F.lit(text), F.coalesce(values[template[i + 1 : end]], F.lit(""))]
            text, i = "", end + 1
        else:
            text, i = text + template[i], i + 1
    return F.concat(*parts, F.lit(text))


def build_prompt(kind: Column, payload: Column, source_lang: Column, target_lang: Column, glossary: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> Column:
    """The whole prompt of each task: system text, a blank line, user text. Null for a kind that isn't known."""
    t = templates or TEMPLATES
    out = None
    for name, p in PROMPTS.items():
        values = {"source_lang": source_lang, "target_lang": target_lang, "glossary_section": F.lit(glossary_section(glossary, t)), p.payload: payload}
        text = strip(F.concat(fill(t[p.system], values), F.lit("\n\n"), fill(t[p.user], values)))
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out


def messages(prompt: Column) -> Column:
    """One user message that holds the prompt."""
    return F.array(F.struct(F.lit("user").alias("role"), F.array(prompt).alias("parts")))


def role_messages(system: Column, user: Column, payload: Column) -> Column:
    """A system and a user message, the payload after a blank line."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), F.concat(user, F.lit("\n\n"), payload).alias("content")))


def segment_request(segments: Column, source_lang: Column, target_lang: Column, out_key: str = "translated_text", simplified_ids: bool = False) -> Column:
    """A request for a batch of segments (JSON of an array) as one JSON object, with what is asked for in words."""
    ids = "seg_N" if simplified_ids else "HH:MM:SS,mmm --> HH:MM:SS,mmm"
    asked = F.concat(F.lit("Translate text_en of each segment from "), source_lang, F.lit(" to "), target_lang, F.lit(f". Return translated_segments, each with its id ({ids}) unchanged and {out_key}."))
    return F.concat(F.lit('{"source_language": "'), source_lang, F.lit('", "target_language": "'), target_lang, F.lit('", "instructions": "'), asked, F.lit('", "segments": '), segments, F.lit("}"))


def book_prompt(values: dict[str, Column], glossary: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> Column:
    """The prompt for a list of a book's texts, with its title, tone and style."""
    t = templates or TEMPLATES
    return fill(t["book_prompt"], {**values, "glossary_section": F.lit(glossary_section(glossary, t))})
