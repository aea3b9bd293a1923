"""Text analysis: tokens, runners, pipelines, stems, edit distance."""
