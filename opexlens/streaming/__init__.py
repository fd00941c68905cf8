"""Structured Streaming: watermarked daily OpEx windows per site."""
