"""A corpus of three guides, and what an index of it must hold."""

HEADS = {"guides/python.md": "Python Packaging", "guides/rust.md": "Rust Guide", "ops/network.md": "Network Notes"}
LINES = {
    "guides/python.md": ["Python environment setup and package installation.", "This document explains virtual environments, " + "pip, and local package workflows."],
    "guides/rust.md": ["Rust guide quickstart, setup, " + "and toolchain installation.", "This document explains rust setup, " + "rust toolchain installation, " + "and how to run the first project."],
    "ops/network.md": ["Latency budgeting and packet traces.", "This document is about network debugging " + "rather than language setup."],
}
TEXTS = {path: "# " + HEADS[path] + "".join("\n\n" + line for line in LINES[path]) + "\n" for path in HEADS}
ID_OF_PYTHON = "383dde8c50270901e5a343014571e012fdeeba678f6c143bb81aa00d2625f3b0"
CHUNKS_OF_PYTHON = [(3063728287153264752, 20, 150, 16), (2775217238747739742, 72, 150, 10)]
QUERIES = [("rust", "rust toolchain setup", "guides/rust.md"), ("python", "python package installation", "guides/python.md"), ("network", "latency packet traces", "ops/network.md")]


def documents(spark):
    return spark.createDataFrame([(p, HEADS[p], TEXTS[p]) for p in TEXTS], "relative_path string, title string, content string")
