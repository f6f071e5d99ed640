"""Lag-kernel feature engine on Spark."""
