"""Readers and writers: journeys, router responses, statistics, feeds, document stores."""
