"""Operators over streams of metric logs."""
