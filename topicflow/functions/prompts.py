"""Prompt templates; ``{abstract}`` and ``{domain}`` are replaced literally.

Jobs take any mapping of names to templates. The few given here differ by purpose: how long the
answer may be, whom it is for, and the form it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TEMPLATES = {
    "headline": "{abstract}\n\nWrite one sentence of at most 25 words that tells what was found. Answer with the sentence only.",
    "newcomer": "A first-year student will read your text.\n\n<text>\n{abstract}\n</text>\n\n"
    "Explain in 60 to 80 everyday words what the authors wanted to know and what they learned.",
    "key_facts": "From the text between the lines take up to five facts, one per line, each starting with '* '. "
    "Use numbers where the text has them.\n---\n{abstract}\n---",
    "reviewer": "You review submissions on {domain}. Here is one:\n\n{abstract}\n\n"
    "State its claim, the evidence offered for it and one open question, in a paragraph.",
}
SUMMARY_TEMPLATE = TEMPLATES["newcomer"]
TOPIC_TEMPLATE = "{texts}\n\nName up to {n} subjects that several of the texts above share, one per line."


def render(template: Column, abstract: Column, domain: str = "machine learning") -> Column:
    """Fill a template; text inside the abstract is never read as a slot."""
    with_domain = F.replace(template, F.lit("{domain}"), F.lit(domain))
    return F.replace(with_domain, F.lit("{abstract}"), abstract)
