"""Relational and temporal operators over lectures, slides, events and transcripts."""
