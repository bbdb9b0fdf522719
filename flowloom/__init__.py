"""A Spark-native engine for typed workflow graphs over data.

Each invocation is a row. State fields carry merge rules, nodes produce partial updates,
edges route rows; fan-out, branches, retries, checkpoints, events, retrieval and prompts are
DataFrame expressions that Catalyst plans.
"""
