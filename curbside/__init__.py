"""Curbside: preparing, checking and measuring annotated image datasets on Spark."""
