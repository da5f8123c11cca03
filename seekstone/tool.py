"""The engine as a tool for agents: a callable from a query to a context text, with a function-calling schema."""

from __future__ import annotations

from typing import Any

from seekstone.schema import SearchMode

#: What callers of the tool rely on.
NOTHING_FOUND = "No relevant context found in knowledge base."
DESCRIPTION = (
    "Looks up passages of the knowledge base that answer a question. Takes a query in natural language and returns the "
    "best passages with their scores."
)
ARGUMENT = "The question or the keywords to look for."


class SearchTool:
    def __init__(
        self,
        engine: Any,
        name: str = "knowledge_base_retriever",
        description: str | None = None,
        top_k: int = 5,
        search_mode: SearchMode = SearchMode.HYBRID,
    ):
        self.engine, self.name, self.description = engine, name, description or DESCRIPTION
        self.top_k, self.search_mode = top_k, search_mode

    def __call__(self, query: str) -> str:
        hits = self.engine.search(query, top_k=self.top_k, mode=self.search_mode)
        blocks = (f"[{n}] (Score: {h.score:.4f}, Doc ID: {h.document_id})\n{h.content}" for n, h in enumerate(hits, 1))
        return "\n\n".join(blocks) or NOTHING_FOUND

    def to_json_schema(self) -> dict[str, Any]:
        parameters = {
            "type": "object",
            "properties": {"query": {"type": "string", "description": ARGUMENT}},
            "required": ["query"],
        }
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": parameters}}

    def to_hf_tool(self) -> Any:
        """A tool object of the agents package where that is installed, else this callable."""
        try:
            from smolagents import Tool
        except ImportError:
            return self
        outer = self

        class Wrapped(Tool):
            inputs = {"query": {"type": "string", "description": ARGUMENT}}
            output_type = "string"
            skip_forward_signature_validation = True

            def __init__(self) -> None:
                self.name, self.description = outer.name, outer.description
                super().__init__()

            def forward(self, query: str) -> str:
                return outer(query)

        return Wrapped()
