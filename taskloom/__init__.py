"""Spark jobs for the data of tool-use environments, of the agents in them, and of training corpora."""
