"""The library's staged tables, for the corpus operators."""

from inkgauge.sources.staged import new_path, remove, scope, shared_folder, stage, stage_alone

__all__ = ["new_path", "remove", "scope", "shared_folder", "stage", "stage_alone"]
