"""Limits and thresholds. Changing one changes which rows pass."""

# retrieval
TOP_K = 4
MIN_RELEVANCE = 0.5
MIN_CONFIDENCE = 0.3

# question screening
MAX_INPUT_TOKENS = 512
INJECTION_THRESHOLD = 0.5
PHONE_DIGITS = (9, 15)

# answer checks
OUTPUT_RETRIES = 1
MIN_GROUNDEDNESS = 0.6
UNCERTAIN_CONFIDENCE = 0.6
UNCERTAIN_RELEVANCE = 0.60
SNIPPET_CHARS = 240

# corpus
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
SELF_RETRIEVAL_FLOOR = 0.95

# release gates: metric -> lowest score that passes
SCORE_GATES = {
    "faithfulness": 0.80,
    "context_precision": 0.70,
    "context_recall": 0.60,
    "answer_relevancy": 0.60,
    "retrieval_recall": 0.90,
    "refusal_accuracy": 0.80,
    "output_validity": 0.95,
}
JUDGED_METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
MIN_COVERAGE = 0.80
TRAJECTORY_GATES = {"trajectory_accuracy": 0.80, "tool_precision": 0.85}

# agent runs
MAX_ITERATIONS = 12
TOKEN_BUDGET = 200_000
TOOLS = ("search_docs", "ask_docs", "predict_soh", "drift_report", "delegate_research")

# monitoring
RECENT_LIMIT = 500
DRIFT_SHARE = 0.5
KS_CRITICAL = 1.358
REQUESTS_PER_MINUTE = 60
AGENT_REQUESTS_PER_MINUTE = 6

# degradation model
FOREST_TREES = 200
# No bound: nodes are split until their labels are equal.
FOREST_DEPTH = None
FOREST_PARTITIONS = 256
# A training task reads so many rows about; further rows get further partitions.
FOREST_PARTITION_ROWS = 400_000
# A tree's node with more draws than this is split by histograms of all tasks, of so many bins; one below it is grown by a task.
FOREST_NODE_ROWS = 600_000
FOREST_BINS = 256
# Bytes of drawn rows that lie on the disks at one time.
FOREST_ROUND_BYTES = 512 * 1024 * 1024
TEST_SHARE = 0.2
SEED = 42
END_OF_LIFE_SOH = 80.0

# Byte bounds behind which a side may be broadcast or held by one task.
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 32 * 1024 * 1024
# Vectors that look for themselves go through the index beyond this.
SELF_BROADCAST_BYTES = 2 * 1024 * 1024
