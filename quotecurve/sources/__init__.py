"""Readers, sinks and the mapping from retail tables to the logical inputs."""
