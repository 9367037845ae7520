"""loomspark.plans"""
