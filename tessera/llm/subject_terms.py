"""Curated subject terms.

Fixed values, by subject and language. A weight of 2 marks words of that field alone, 1 words that other fields use too.
"""

TERMS = {
    "genetics": {
        2: """gene genes genetic genetics genome genomes genomic intron introns exon exons locus loci allele alleles codon codons
            chromosome chromosomes chromatin histone histones nucleotide nucleotides polymerase ribosome ribosomes helicase telomere
            telomeres plasmid plasmids haplotype haplotypes pedigree splice-site spliced splicing mutation mutations mutated mutant
            heterozygous homozygous polymorphic polymorphism epigenetic methylated methylation mitotic meiotic somatic recessive
            sequenced sequencing transcribed transcription inherited inheritance heredity replicated cloned silenced genotype
            基因 基因组 转录 转录本 突变 单倍型 密码子 启动子 端粒 等位基因 染色体 外显子 内含子 核苷酸 剪接 测序 遗传 核糖体 质粒 表观遗传 聚合酶""",
        1: """promoter enhancer transcript primer translated dominant 翻译 复制""",
    },
    "clinical": {
        2: """patient patients bedside ward wards nurse nurses surgeon surgeons surgery surgical suture sutures catheter incision incisions
            anamnesis bandage bandaged auscultation auscultated palpation palpated stretcher biopsy intubation intubated drainage
            postoperative febrile feverish fever comatose bedridden ambulatory rash wound wounds diagnosis diagnosed symptom symptoms
            pulse 诊断 引流管 缝合 病房 切口 护士 查体 病人 发热 入院 出院 伤口 脉搏 触诊 会诊 手术台 查房 听诊 插管 症状 外科""",
        1: """tender pale swollen admitted discharge discharged drained operated examined hospital""",
    },
    "pharma": {
        2: """tablet tablets capsule capsules excipient excipients bioavailability bioequivalent placebo prodrug contraindication syrup
            dissolution formulation formulated ointment ampoule half-life infusion intravenous sublingual topical dosage dosages dose
            doses dosed overdose pharmacokinetic lozenge sustained-release titrated prescribed metabolised adjuvant compounded
            dispensed pharmacy 处方 生物利用度 胶囊 辅料 安慰剂 禁忌 剂量 软膏 给药 半衰期 溶出度 配制 滴定 清除率 片剂 排泄 代谢 糖浆 药物 药代动力学""",
        1: """soluble oral tolerance generic clearance absorbed excreted dissolved 吸收""",
    },
    "epidemiology": {
        2: """epidemic epidemics epidemiology outbreak outbreaks prevalence seroprevalence incidence vaccination vaccinated unvaccinated
            quarantine quarantined surveillance census mortality morbidity contact-tracing age-adjusted population-wide endemic zoonotic
            waterborne immunised transmission transmitted sanitation infected 疫情 暴发 流行病 流行 监测 筛查 接触者 人口 隔离 患病率 死亡率 上报 发病率
            传播 传播链 社区 接种 疫苗 感染 检疫""",
        1: """reservoir exposure household district seasonal screening screened surveyed notified isolated catchment communal""",
    },
    "software": {
        2: """parser parsers parsed repository repositories tokenizer compiler compilers compiled endpoint endpoints stacktrace traceback
            runtime scheduler database databases refactored debugged deployed benchmarked serialised multithreaded asynchronous idempotent
            stateless backward-compatible open-source deprecated config cache cached software bug bugs server servers commit commits
            编译 缓存 日志 代码 编译器 函数 分支 重构 数据库 服务器 部署 线程 解析 仓库 调试 接口 调度器 软件 程序 队列 容器 提交 回滚""",
        1: """function thread branch queue container interface merged logged latency nightly 合并""",
    },
    "law": {
        2: """statute statutes statutory court courts plaintiff plaintiffs defendant defendants claimant attorney attorneys tribunal verdict
            jurisdiction injunction testimony testified litigated litigation adjudicated judicial liability liable negligence unlawful
            contractual punitive enforceable precedent consent-form clause clauses repealed enacted sued lawsuit law legal
            上诉 条款 起诉 判决 责任 证词 授权 赔偿 举证 仲裁 法院 原告 被告 律师 诉讼 法规 合同 管辖权 违约 裁定 法庭 证人 知情同意""",
        1: """contract appeal appealed regulation hearing licence licensed civil damages ruled waived""",
    },
    "sport": {
        2: """athlete athletes athletic sprint sprints sprinted marathon referee coach coached stadium goalkeeper tournament championship
            league scorer unbeaten off-season jersey hurdle relay dribble medalled outran gymnast tackled podium training-camp first-team
            endurance-based rowing warm-up aerobic sport sports football 教练 联赛 晋级 短跑 接力 夺冠 裁判 得分 锦标赛 球场 替补 马拉松 运动员 比赛 球队 守门员
            训练 冠军 赛季 体能 热身 决赛 跨栏 射门 领奖台""",
        1: """match season competitive muscular raced trained qualified substituted scored""",
    },
    "economics": {
        2: """budget budgets budgeted reimbursement reimbursed insurer insured uninsured copayment subsidy subsidies subsidised invoice
            invoiced tariff tariffs expenditure deficit revenue procurement procured fiscal ledger deductible deductible-free
            cost-effectiveness cost-effective overspent price-index per-capita inflation prepaid financed payroll annualised taxed audit
            audited economy economic price prices 发票 报销 审计 价格 投保 账目 采购 预算 保险 保费 补贴 成本 赤字 通货膨胀 财政 税 支出 收入 支付 招标 自付额
            结算 费用""",
        1: """premium balance quarterly tender""",
    },
}
