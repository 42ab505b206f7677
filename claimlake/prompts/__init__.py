"""Prompts and templates: one text file each, with placeholders in double braces."""

from __future__ import annotations

from importlib import resources

#: What an answer says where the context holds none, and how warm each use of a model is: fixed values.
REFUSAL = "The answer is not available in the provided document."
TEMPERATURES = {"update": 0.2, "summary": 0.1, "extraction": 0.1, "question": 0.3}
#: What a model is told to be, by use.
ROLES = {
    "update": "You keep insurance claim files. Fold each new document into the claim's diary and log what it changes. Stay exact, brief and neutral.",
    "summary": "You keep insurance claim files. Pick the facts that matter most from a claim and lay them out in one short table.",
    "extraction": "You read insurance claim documents and answer with one valid JSON object, and nothing besides it.",
    "question": "You answer questions about documents of any language and length from what they say alone.",
}


def load(name: str) -> str:
    """The text of a prompt; a missing one raises FileNotFoundError."""
    file = resources.files(__package__) / f"{name}.md"
    if not file.is_file():
        raise FileNotFoundError(f"no prompt {name!r}")
    return file.read_text(encoding="utf-8")


def template(name: str) -> str:
    """The text that a claim's diary or ledger starts with; a one-line heading where there is no such template."""
    try:
        return load(f"{name}_template")
    except FileNotFoundError:
        return f"# {name.capitalize()}\n"


def fill(text: str, values: dict[str, str]) -> str:
    """Fill placeholders one after the other, so that a value may hold a later placeholder."""
    for key, value in values.items():
        text = text.replace("{{" + key + "}}", str(value))
    return text
