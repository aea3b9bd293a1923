"""The query language: syntax trees and their compilation to DataFrames."""
