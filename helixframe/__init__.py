"""Helixframe: transcript, alignment and interval analytics as Spark DataFrame operators."""
