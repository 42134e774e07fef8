"""Durable results of commands."""
