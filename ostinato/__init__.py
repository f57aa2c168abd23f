"""Spark operators for labelled collections of multichannel series and event sequences."""
