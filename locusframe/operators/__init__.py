"""Operators on tables of reads, targets, regions and records."""
