"""Plan shapes (dictionary_apply, global_index) and the end-to-end corpus jobs."""
