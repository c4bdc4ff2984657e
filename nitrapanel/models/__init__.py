"""Splits, baseline predictors, boosted trees and their metrics."""
