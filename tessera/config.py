"""Settings of a retrieval run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    corpus_version: str = "v2"
    model: str = "bge-m3"
    chunk_tokens: int = 400
    chunk_overlap: int = 50
    candidates: int = 20
    top_k: int = 4
    threshold: float = 0.5
    confidence_medium: float = 0.7
    confidence_high: float = 0.9
    min_words: int = 15
    quote_chars: int = 300

    @property
    def tag(self) -> str:
        """Name of the index that this configuration builds."""
        return f"guia_{self.corpus_version}_{self.model.rsplit('/', 1)[-1]}_c{self.chunk_tokens}o{self.chunk_overlap}"

    def n_candidates(self, rerank: bool) -> int:
        return max(self.candidates if rerank else self.top_k, self.top_k)


DEFAULT = Settings()

# Where the guide's sections, activities and tools begin (names are ours but for what they stand for), the
# stage each of seven activities belongs to, and the pages that are indexed.
SECTIONS = [(p, f"Section {i:02d}") for i, p in enumerate((1, 8, 10, 13, 23, 27, 28, 32, 36, 40, 44, 51, 158, 162, 164), 1)]
ACTIVITIES = [
    (p, f"Activity {i:02d}")
    for i, p in enumerate((54, 58, 64, 68, 72, 76, 80, 86, 90, 94, 100, 104, 108, 112, 116, 120, 126, 132, 140, 150, 154), 1)
]
TOOLS = [
    (p, f"Tool {i:02d}")
    for i, p in enumerate((56, 60, 66, 70, 74, 78, 82, 88, 92, 96, 102, 106, 110, 114, 118, 122, 128, 134, 136, 142, 148, 152, 156), 1)
]
STAGES = [(1, "Activity 13"), (2, "Activity 19"), (3, "Activity 11"), (4, "Activity 18"), (5, "Activity 21"), (6, "Activity 15"), (7, "Activity 17")]
ALLOWED_PAGES = [(2, 3), (8, 12), (13, 164)]
ACTIVITY_PAGES = (54, 158)
#: Thresholds of the sweep and edges of the score bands.
THRESHOLDS = [0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
BANDS = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.01]
#: Curated texts that replace what was extracted from a page.
OVERRIDES = [(2, "Credits of the guide. The authors are named on this page, which stands in for the text taken from the layout of the page.")]
TEMPLATES = [
    ("plain", "", ""),
    ("instruct", "", "Instruct: Find the parts of the guide in which a reader's question is settled\nQuery: "),
    ("task", "title: none | text: ", "task: search result | query: "),
]
REFUSAL = "No reliable information was found in the guide."
ADVICE = "Try to ask in other words."
