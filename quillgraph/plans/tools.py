"""Retrieval tools by name, with checked arguments, as an agent or a server offers them (each answers with a DataFrame)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import graph, register, retrieval
from quillgraph.plans import patterns
from quillgraph.sources.adapter import Corpus
from quillgraph.sources.sinks import letter_triples


@dataclass(frozen=True)
class Tool:
    """What a tool does, the arguments that it can't do without, and those it can."""

    doc: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    run: Callable[..., DataFrame]


class Toolbox:
    """The tools over one corpus."""

    def __init__(self, corpus: Corpus, base: str = "https://example.org/"):
        self.corpus, self.base = corpus, base
        one = lambda key: corpus.spark.range(1).select(F.lit(key).cast("long").alias("letter"))
        self.tools = {
            "lookup_entity": Tool("ids for a name", ("name",), ("limit",), lambda name, limit=8: register.lookup_entity(self.entities(), name, limit=limit)),
            "semantic_search": Tool("letters near a vector", ("vector",), ("k", "date_from", "date_to"), lambda vector, k=10, date_from=None, date_to=None: retrieval.semantic_search(retrieval.letter_vectors(corpus.chunks), corpus.letters, retrieval.literal_vector(vector), k, date_from, date_to)),
            "get_letter": Tool("one letter and what it mentions", ("id",), ("most",), lambda id, most=25: graph.letter_record(corpus.letters, corpus.mentions, id, most)),  # noqa: A006
            "graph_neighbors": Tool("what a node is linked to", ("key",), (), lambda key: graph.neighbors(self.edges(), self.nodes(), key)),
            "shared_mentions": Tool("letters with the same mentions", ("id",), ("least",), lambda id, least=2: graph.shared_mentions(corpus.mentions, one(id), least)),  # noqa: A006
            "correspondence_context": Tool("letters of the same two around the date", ("id",), ("days",), lambda id, days=90: graph.correspondence_context(corpus.letters, one(id), days)),  # noqa: A006
            "sparql": Tool("a read-only query over the triples", ("query",), ("limit",), lambda query, limit=40: patterns.run(letter_triples(corpus.letters, self.base), query).limit(limit)),
            "cypher": Tool("a read-only path query", ("query",), ("limit",), lambda query, limit=100: patterns.cypher(self.nodes(), self.edges(), query, limit)),
        }

    def entities(self) -> DataFrame:
        c = self.corpus
        return c.persons.select("id", "label").unionByName(c.places.select("id", "label")).unionByName(c.works.select("id", "label"))

    def nodes(self) -> DataFrame:
        c = self.corpus
        return graph.build_nodes(c.letters, {"Person": c.persons, "Place": c.places, "Work": c.works})

    def edges(self) -> DataFrame:
        return graph.build_edges(self.corpus.letters, self.corpus.mention_rows)

    def call(self, name: str, arguments: dict | None = None) -> DataFrame:
        """runs a tool; unknown tools, and missing or unknown arguments, are errors."""
        if name not in self.tools:
            raise ValueError(f"unknown tool: {name}; there are {', '.join(self.tools)}")
        tool, given = self.tools[name], dict(arguments or {})
        if missing := [a for a in tool.required if given.get(a) in (None, "")]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        if unknown := sorted(set(given) - {*tool.required, *tool.optional}):
            raise ValueError(f"{name} has no {', '.join(unknown)}")
        return tool.run(**given)


def first_object(text: str) -> dict | None:
    """The first whole JSON object in a text; None if there is none."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
            continue
        return found if isinstance(found, dict) else None
    return None


def parse_action(text: str) -> tuple[str, dict] | None:
    """The tool and arguments that a reply asks for, under any of the usual names; None for a plain answer."""
    found = first_object(text)
    if not found:
        return None
    name = next((found[k] for k in ("tool", "action", "name") if isinstance(found.get(k), str)), None)
    given = next((found[k] for k in ("args", "arguments", "input", "parameters") if isinstance(found.get(k), dict)), {})
    return (name, given) if name else None
