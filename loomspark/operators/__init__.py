"""loomspark.operators"""
