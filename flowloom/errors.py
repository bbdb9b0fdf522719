"""Error categories, as plan-time exceptions and as values of a row's error column."""

from __future__ import annotations

#: Categories raised while a graph is compiled.
COMPILE_CATEGORIES = (
    "no_declared_entry", "unreachable_node", "dangling_edge", "multiple_outgoing_edges", "conflicting_reducers",
    "mapping_references_undeclared_field", "conflicting_projection_forms", "fan_out_count_mode_ambiguous", "fan_out_field_not_list",
    "fan_out_degraded_update_missing_collect_field", "parallel_branches_no_branches", "parallel_branches_invalid_branch_spec",
)
#: Categories of rows that fail.
RUN_CATEGORIES = ("node_exception", "parallel_branches_branch_failed", "edge_exception", "reducer_error", "routing_error", "state_validation_error")
#: What a failed fan-out says besides node_exception.
FAN_OUT_CATEGORIES = ("fan_out_empty", "fan_out_invalid_count", "fan_out_invalid_concurrency")
#: Checkpoint categories.
CHECKPOINT_CATEGORIES = (
    "checkpoint_not_found", "checkpoint_save_failed", "checkpoint_record_invalid", "checkpoint_state_migration_missing",
    "checkpoint_state_migration_chain_ambiguous", "checkpoint_state_migration_failed",
)
#: Provider categories, the transient ones apart.
TRANSIENT_CATEGORIES = ("provider_rate_limit", "provider_unavailable", "provider_model_not_loaded")
PROVIDER_CATEGORIES = (
    "provider_authentication", "provider_invalid_model", "provider_invalid_request", "provider_invalid_response",
    "provider_unsupported_content_block", "structured_output_invalid", *TRANSIENT_CATEGORIES,
)
#: Prompt categories.
PROMPT_CATEGORIES = ("prompt_not_found", "prompt_render_error", "prompt_store_unavailable", "prompt_group_invalid")

#: The error column of a row: null while all is well.
ERROR_TYPE = "struct<category:string,message:string,node:string,fan_out_category:string>"


class FlowError(Exception):
    """An error with a category; `subject` names the node, field or version at fault."""

    def __init__(self, category: str, message: str = "", subject: str | None = None):
        super().__init__(f"{category}: {message}" if message else category)
        self.category, self.message, self.subject = category, message, subject


class CompileError(FlowError):
    """A graph that can't be run; category is one of COMPILE_CATEGORIES."""


class RunError(FlowError):
    """Raised by strict runs when a row has failed."""


class CheckpointError(FlowError):
    """A checkpoint that can't be saved, found, read or migrated."""


class ProviderError(FlowError):
    """A provider call that was refused or failed."""


class PromptError(FlowError):
    """A prompt that can't be fetched, rendered or grouped."""
